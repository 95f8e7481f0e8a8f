"""FLAC (RFC 9639): blocks, frame index, frames, and the encoder's packer.

Frames hold no state of others: `index` finds them in one pass (a frame is taken where its header's
CRC-8 holds and the one before it closes on its CRC-16), and each is decoded for itself.
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass

import numpy as np

from tonewright.sources.bits import BitSink, Bits, crc8, crc16
from tonewright.sources.errors import AudioError, AudioError as Error, bad_data, bad_header, ended
from tonewright.sources.info import Decoded, info

BLOCK = 4096
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
SIZES = {1: 192} | {k: 144 << k for k in range(2, 6)} | {k: 1 << k for k in range(8, 16)}
LEFT_SIDE, RIGHT_SIDE, MID_SIDE = 8, 9, 10
HEAD = 20  # no frame header is longer
FEW = 6  # subframes from which on steps over all of them are faster than each for itself


@dataclass
class StreamInfo:
    min_block: int
    max_block: int
    min_frame: int
    max_frame: int
    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes


@dataclass
class Metadata:
    info: StreamInfo
    seek_points: list[tuple[int, int, int]]
    audio_at: int
    blocks: list[tuple[int, int, int]]  # type, offset, bytes


@dataclass
class Frame:
    number: int
    at: int
    size: int
    start: int  # first sample
    block: int
    channel_code: int
    bits: int
    body: int  # offset of the first subframe within the frame


def streaminfo(raw: bytes) -> StreamInfo:
    if len(raw) < 34:
        raise bad_header("STREAMINFO too short")
    word = int.from_bytes(raw[10:18], "big")
    found = StreamInfo(
        *struct.unpack(">HH", raw[:4]), int.from_bytes(raw[4:7], "big"), int.from_bytes(raw[7:10], "big"),
        word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & (1 << 36) - 1, raw[18:34],
    )
    if not found.rate:
        raise AudioError("InvalidSampleRate", "0")
    return found


def metadata(data: bytes) -> Metadata:
    if data[:4] != b"fLaC":
        raise bad_header("missing fLaC magic")
    at, found, points, blocks = 4, None, [], []
    while True:
        if at + 4 > len(data):
            raise ended("metadata")
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        raw = data[at + 4 : at + 4 + size]
        if len(raw) < size:
            raise ended("metadata")
        blocks.append((kind, at + 4, size))
        if kind == 0:
            found = streaminfo(raw)
        elif kind == 3:
            points += [p for p in struct.iter_unpack(">QQH", raw[: size // 18 * 18]) if p[0] != (1 << 64) - 1]
        at += 4 + size
        if last:
            break
    if found is None:
        raise bad_header("missing STREAMINFO")
    return Metadata(found, points, at, blocks)


SYNC = re.compile(rb"\xff[\xf8\xf9]", re.DOTALL)


def frame_header(data: bytes, at: int, stream: StreamInfo) -> Frame | None:
    """The frame whose header stands at the offset, without its size; None if its CRC-8 fails."""
    raw = data[at : at + 20]
    if len(raw) < 6:
        return None
    bits = Bits(raw)
    try:
        bits.at = 15
        variable, size, rate, channels, depth, zero = (bits.uint(n) for n in (1, 4, 4, 4, 3, 1))
        number = bits.coded()
        if not size or rate == 15 or depth == 3 or channels > MID_SIDE or zero:
            return None
        block = SIZES[size] if size in SIZES else bits.uint(8 if size == 6 else 16) + 1
        if rate >= 12:
            bits.uint(8 if rate == 12 else 16)
        end = bits.at // 8
        if crc8(raw[:end]) != bits.uint(8):
            return None
    except Error:
        return None
    start = number if variable else number * (stream.max_block if stream.min_block == stream.max_block else block)
    return Frame(number, at, 0, start, block, channels, DEPTHS.get(depth, stream.bits), end + 1)


def index(data: bytes, meta: Metadata | None = None, at: int | None = None, whole: bool = True, end: int | None = None) -> list[Frame]:
    """Frames from an offset (the first by default), up to that of sample end.

    A last frame that doesn't close is an error if whole, else left out.
    """
    meta = meta or metadata(data)
    at = meta.audio_at if at is None else at
    frames: list[Frame] = []
    now = None
    for m in SYNC.finditer(data, at):
        found = frame_header(data, m.start(), meta.info)
        if found is None:
            if now is None and m.start() == at and (whole or at + 20 <= len(data)):
                raise bad_data("CRC-8 mismatch in a frame header")
            continue
        if now is not None:
            if m.start() < now.at + now.body + 2 or not _closed(data, now.at, m.start()):
                continue
            now.size = m.start() - now.at
            frames.append(now)
        if end is not None and found.start >= end:
            return frames
        now = found
    if now is not None:
        end = _end(data, now, meta.info)
        if end is not None:
            now.size = end - now.at
            frames.append(now)
        elif whole:
            raise bad_data("CRC-16 mismatch or cut frame")
    return frames


class Scanner:
    """Finds closed frames in audio bytes that come piece by piece; each byte is searched and summed up once."""

    def __init__(self, stream: StreamInfo):
        self.stream, self.data, self.now = stream, bytearray(), None
        self.look = self.crc = self.crc_at = 0

    def feed(self, more: bytes) -> list[tuple[bytes, Frame]]:
        """The frames that the header of a next one closes."""
        self.data += more
        out = []
        places = [m.start() for m in SYNC.finditer(self.data, self.look)]
        for at in places:
            self.look = at
            if at + HEAD > len(self.data):  # the header may be cut
                break
            self.look = at + 1
            found = frame_header(self.data, at, self.stream)
            if found is None:
                if self.now is None and at == 0:
                    raise bad_data("CRC-8 mismatch in a frame header")
                continue
            if self.now is not None:
                if at < self.now.at + self.now.body + 2:
                    continue
                self.crc, self.crc_at = crc16(bytes(self.data[self.crc_at : at]), self.crc), at
                if self.crc:
                    continue
                self.now.size = at - self.now.at
                out.append((bytes(self.data[self.now.at : at]), self.now))
            self.now, self.crc, self.crc_at = found, 0, at
        else:
            self.look = max(self.look, len(self.data) - 1)  # a sync code may be cut
        if out:
            cut = self.now.at
            del self.data[:cut]
            self.now.at, self.look, self.crc_at = 0, self.look - cut, self.crc_at - cut
        return out

    def rest(self, meta: Metadata) -> list[tuple[bytes, Frame]]:
        """The frames left at the end of the stream."""
        data = bytes(self.data)
        return [(data[f.at : f.at + f.size], f) for f in index(data, meta, self.now.at if self.now else 0)] if data else []


def _closed(data: bytes, start: int, end: int) -> bool:
    return end - start > 2 and crc16(data[start : end - 2]) == int.from_bytes(data[end - 2 : end], "big")


def _end(data: bytes, frame: Frame, stream: StreamInfo) -> int | None:
    """Where the last frame closes: the end of the data, or after its subframes if other bytes follow."""
    if _closed(data, frame.at, len(data)):
        return len(data)
    try:
        bits = Bits(data[frame.at :], frame.body)
        _parsed(bits, frame)
    except (Error, IndexError):
        return None
    bits.align()
    end = frame.at + bits.at // 8 + 2
    return end if end <= len(data) and _closed(data, frame.at, end) else None


def _residual(bits: Bits, block: int, order: int) -> np.ndarray:
    method = bits.uint(2)
    if method > 1:
        raise bad_data(f"unsupported residual coding method: {method}")
    width, parts = 4 + method, bits.uint(4)
    if parts and (block >> parts) << parts != block or block >> parts < order:
        raise bad_data("partitions don't divide the block")
    out = []
    for p in range(1 << parts):
        n = (block >> parts) - (order if p == 0 else 0)
        k = bits.uint(width)
        out.append(bits.array(n, bits.uint(5)) if k == (1 << width) - 1 else bits.rice(n, k))
    return np.concatenate(out)


@dataclass
class Predicted:
    """A subframe of linear prediction, not restored yet."""

    warm: np.ndarray
    taps: np.ndarray
    shift: int
    residual: np.ndarray
    wasted: int


def _subframe(bits: Bits, block: int, depth: int) -> np.ndarray:
    return restored([_parsed_subframe(bits, block, depth)])[0]


def _parsed_subframe(bits: Bits, block: int, depth: int) -> np.ndarray | Predicted:
    if bits.uint(1):
        raise bad_data("subframe header zero bit is not zero")
    kind = bits.uint(6)
    wasted = bits.unary() + 1 if bits.uint(1) else 0
    depth -= wasted
    if depth <= 0:
        raise bad_data("wasted bits exceed the depth")
    if kind == 0:
        out = np.full(block, bits.sint(depth), np.int64)
    elif kind == 1:
        out = bits.array(block, depth)
    elif 8 <= kind <= 12:
        order = kind - 8
        if order > block:
            raise bad_data("order exceeds the block")
        warm = bits.array(order, depth)
        out = fixed_restore(warm, _residual(bits, block, order))
    elif kind >= 32:
        order = kind - 31
        if order > block:
            raise bad_data("order exceeds the block")
        warm, precision = bits.array(order, depth), bits.uint(4) + 1
        if precision == 16:
            raise bad_data("invalid coefficient precision")
        shift = bits.sint(5)
        return Predicted(warm, bits.array(order, precision), shift, _residual(bits, block, order), wasted)
    else:
        raise bad_data(f"reserved subframe type: {kind}")
    return out << wasted


def fixed_restore(warm: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The inverse of an order's finite difference is as many running sums, each from its own first value."""
    firsts, level = [], warm
    for _ in range(len(warm)):
        firsts.append(level[0])
        level = np.diff(level)
    out = residual
    for first in reversed(firsts):
        out = np.concatenate([[first], first + np.cumsum(out)])
    return out.astype(np.int64)


def lpc_restore(warm: np.ndarray, coefficients: np.ndarray, shift: int, residual: np.ndarray) -> np.ndarray:
    out, taps = warm.tolist(), coefficients.tolist()
    n = len(taps)
    for r in residual.tolist():
        total = sum(c * s for c, s in zip(taps, out[: -n - 1 : -1]))
        out.append(r + (total >> shift if shift >= 0 else total << -shift))
    return np.array(out, np.int64)


def _in_step(parts: list[Predicted]) -> list[np.ndarray]:
    """Subframes of one order and length, sample by sample, all of them at once."""
    order, rest = len(parts[0].warm), np.stack([p.residual for p in parts], axis=1)
    taps, shift = np.stack([p.taps[::-1] for p in parts], axis=1), np.array([p.shift for p in parts])
    out = np.empty((order + len(rest), len(parts)), np.int64)
    out[:order] = np.stack([p.warm for p in parts], axis=1)
    for t in range(len(rest)):
        out[order + t] = rest[t] + ((taps * out[t : t + order]).sum(0) >> shift)
    return list(np.ascontiguousarray(out.T))


def restored(parts: list[np.ndarray | Predicted]) -> list[np.ndarray]:
    """Samples of all subframes; those that a recurrence restores go in step, by order and length."""
    out: list[np.ndarray] = list(parts)
    groups: dict[tuple[int, int, int], list[int]] = {}
    for i, p in enumerate(parts):
        if isinstance(p, Predicted):
            alone = i + 1 if p.shift < 0 else 0  # no such shift is allowed; it could exceed 64 bits
            groups.setdefault((len(p.warm), len(p.residual), alone), []).append(i)
    for own in groups.values():
        some = [parts[i] for i in own]
        values = _in_step(some) if len(some) >= FEW else [lpc_restore(p.warm, p.taps, p.shift, p.residual) for p in some]
        for i, v in zip(own, values, strict=True):
            out[i] = v << parts[i].wasted
    return out


def decorrelate(a: np.ndarray, b: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
    if code == LEFT_SIDE:
        return a, a - b
    if code == RIGHT_SIDE:
        return a + b, b
    total = a << 1 | b & 1
    return total + b >> 1, total - b >> 1


def _parsed(bits: Bits, frame: Frame) -> list[np.ndarray | Predicted]:
    code = frame.channel_code
    if code < LEFT_SIDE:
        return [_parsed_subframe(bits, frame.block, frame.bits) for _ in range(code + 1)]
    return [_parsed_subframe(bits, frame.block, frame.bits + side) for side in (code == RIGHT_SIDE, code != RIGHT_SIDE)]


def decode_frames(frames: list[tuple[bytes, Frame]], closed: bool = False) -> list[np.ndarray]:
    """Integers (block, channels) of whole frames; closed: their check sums are known to hold."""
    parsed = []
    for raw, frame in frames:
        if not closed and not _closed(raw, 0, len(raw)):
            raise bad_data("CRC-16 mismatch")
        parsed.append(_parsed(Bits(raw, frame.body), frame))
    planes, out = iter(restored([p for parts in parsed for p in parts])), []
    for (_, frame), parts in zip(frames, parsed, strict=True):
        own = [next(planes) for _ in parts]
        out.append(np.stack(own if frame.channel_code < LEFT_SIDE else decorrelate(*own, frame.channel_code), axis=1))
    return out


def decode_frame(raw: bytes, frame: Frame) -> np.ndarray:
    return decode_frames([(raw, frame)])[0]


def scaled(values: np.ndarray, bits: int) -> np.ndarray:
    return (values * 2.0 ** (1 - bits)).astype(np.float32)


def seek(meta: Metadata, start: int) -> int:
    """Where to look for the frame of a sample: at the last seek point that isn't after it, else at the first frame."""
    return max((meta.audio_at + p[1] for p in meta.seek_points if p[0] <= start and p[2]), default=meta.audio_at)


def decode_range(data: bytes, start: int = 0, end: int | None = None) -> Decoded:
    """Frames start to end; the index is searched from the last seek point at or before the start."""
    meta = metadata(data)
    s = meta.info
    at = seek(meta, start)
    wanted = [f for f in index(data, meta, at, end=end) if f.start + f.block > start and (end is None or f.start < end)]
    out = []
    for f, values in zip(wanted, decode_frames([(data[f.at : f.at + f.size], f) for f in wanted], closed=True), strict=True):
        low, high = max(0, start - f.start), f.block if end is None else min(f.block, end - f.start)
        out.append(scaled(values[low:high], s.bits))
    samples = np.concatenate(out).ravel() if out else np.zeros(0, np.float32)
    return info("Flac", s.rate, s.channels, s.bits, len(samples) // s.channels), samples


def decode(data: bytes) -> Decoded:
    return decode_range(data)


# Encoder: mid/side for stereo, fixed predictors or verbatim, one Rice partition.


def quantise(samples: np.ndarray, bits: int) -> np.ndarray:
    s = np.nan_to_num(np.clip(np.asarray(samples, np.float32), -1, 1), nan=0.0).astype(np.float64)
    return np.trunc(s * float((1 << (bits - 1)) - 1)).astype(np.int64)


def zigzag(values: np.ndarray) -> np.ndarray:
    return values << 1 ^ values >> 63


def rice_param(total: int, n: int) -> int:
    mean = total // n if n else 0
    return min(14, mean.bit_length() - 1) if mean else 0


def choose(values: np.ndarray, bits: int) -> tuple[int, int, np.ndarray, int] | None:
    """(order, parameter, zigzag residuals, cost) of the cheapest fixed predictor; None if verbatim is no dearer."""
    best, level = None, values
    for order in range(min(4, len(values)) + 1):
        z = zigzag(level)
        k = rice_param(int(z.sum()), len(z))
        cost = 14 + bits * order + int((z >> k).sum()) + len(z) * (1 + k)
        if best is None or cost < best[3]:
            best = order, k, z, cost
        level = np.diff(level)
    return None if 8 + bits * len(values) <= best[3] or len(values) <= 4 else best


def _pack_subframe(sink: BitSink, values: np.ndarray, bits: int, chosen=choose) -> None:
    best = chosen(values, bits)
    if best is None:
        sink.uint(2, 8)
        sink.array(values, bits)
        return
    order, k, z, _ = best
    sink.uint((8 + order) << 1, 8)
    sink.array(values[:order], bits)
    sink.uint(k, 10)  # method 0, partition order 0, parameter
    sink.rice(z, k)


def size_code(n: int) -> tuple[int, int]:
    return next(((k, 0) for k, v in SIZES.items() if v == n), (6, 8) if n <= 256 else (7, 16))


def rate_code(rate: int) -> tuple[int, int, int]:
    """Code, bits that follow, value that follows."""
    for k, v in RATES.items():
        if v == rate:
            return k, 0, 0
    if rate % 1000 == 0 and rate <= 255000:
        return 12, 8, rate // 1000
    if rate <= 65535:
        return 13, 16, rate
    return (14, 16, rate // 10) if rate % 10 == 0 and rate <= 655350 else (0, 0, 0)


def pack_frame(values: np.ndarray, rate: int, bits: int, number: int, chosen: list | None = None) -> bytes:
    """One frame of integers (block, channels); chosen has for each coded channel what stands in for `choose`."""
    block, channels = values.shape
    how = chosen or [choose] * channels
    head = BitSink()
    code, tail = size_code(block)
    rcode, rtail, rvalue = rate_code(rate)
    depth = next((k for k, v in DEPTHS.items() if v == bits and k < 7), 0)
    head.uint(0xFFF8, 16)
    head.uint(code << 4 | rcode, 8)
    head.uint((MID_SIDE if channels == 2 else channels - 1) << 4 | depth << 1, 8)
    head.coded(number)
    if tail:
        head.uint(block - 1, tail)
    if rtail:
        head.uint(rvalue, rtail)
    raw = head.bytes()
    body = BitSink()
    if channels == 2:
        left, right = values[:, 0], values[:, 1]
        _pack_subframe(body, left + right >> 1, bits, how[0])
        _pack_subframe(body, left - right, bits + 1, how[1])
    else:
        for c in range(channels):
            _pack_subframe(body, values[:, c], bits, how[c])
    raw += bytes([crc8(raw)]) + body.bytes()
    return raw + crc16(raw).to_bytes(2, "big")


def check_params(rate: int, channels: int, bits: int) -> None:
    if not 1 <= channels <= 8:
        raise AudioError("InvalidChannels", str(channels))
    if not 0 < rate < 1 << 20:
        raise AudioError("InvalidSampleRate", str(rate))
    if not 1 <= bits <= 32 or bits == 32 and channels == 2:
        raise AudioError("EncodeError", f"unsupported bit depth: {bits} for {channels} channels")


def md5_of(values: np.ndarray, bits: int) -> bytes:
    width = (bits + 7) // 8
    return hashlib.md5(values.ravel().astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()).digest()


def stream_head(rate: int, channels: int, bits: int, frames: int, sizes: list[int], md5: bytes) -> bytes:
    """The magic and the STREAMINFO block."""
    block = max(1, min(BLOCK, frames))
    low, high = (min(sizes), max(sizes)) if sizes else (0, 0)
    word = rate << 44 | channels - 1 << 41 | bits - 1 << 36 | frames
    return b"fLaC\x80\0\0\x22" + struct.pack(">HH", block, block) + low.to_bytes(3, "big") + high.to_bytes(3, "big") + word.to_bytes(8, "big") + md5


def encode(samples: np.ndarray, rate: int, channels: int, bits: int = 16) -> bytes:
    check_params(rate, channels, bits)
    n = len(samples) // channels
    values = quantise(samples, bits)
    md5 = md5_of(values, bits)
    values = values[: n * channels].reshape(n, channels)
    frames = [pack_frame(values[i : i + BLOCK], rate, bits, i // BLOCK) for i in range(0, n, BLOCK)]
    return stream_head(rate, channels, bits, n, [len(f) for f in frames], md5) + b"".join(frames)
