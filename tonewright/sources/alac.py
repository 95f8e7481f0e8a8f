"""ALAC: the 24-byte cookie and one frame, after the public format (adaptive Rice, adaptive prediction)."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from tonewright.sources.bits import Bits, BitSink
from tonewright.sources.errors import AudioError, bad_data, bad_header, ended
from tonewright.sources.info import Decoded, info

SINGLE, PAIR, LFE, END = 0, 1, 3, 7
FEW = 16  # channels from which on steps over all of them are faster than each for itself
MOST_SAMPLES = 16384


@dataclass
class Config:
    frame_length: int
    bit_depth: int
    pb: int
    mb: int
    kb: int
    num_channels: int
    max_run: int
    max_frame_bytes: int
    avg_bit_rate: int
    sample_rate: int


def config(data: bytes) -> Config:
    if len(data) < 24:
        raise bad_header("ALACSpecificConfig requires 24 bytes")
    length, version, *rest = struct.unpack(">IBBBBBBHIII", data[:24])
    found = Config(length, *rest)
    if version:
        raise bad_header(f"unsupported ALAC version: {version}")
    if found.bit_depth not in (16, 20, 24, 32):
        raise bad_header(f"unsupported ALAC bit depth: {found.bit_depth}")
    if not 1 <= found.num_channels <= 8:
        raise AudioError("InvalidChannels", str(found.num_channels))
    if not found.sample_rate:
        raise AudioError("InvalidSampleRate", "0")
    return found


def _scalar(bits: Bits, m: int, k: int, wide: int) -> int:
    """A Rice code with quotients of 1s, at most nine of them before a raw value."""
    quotient = 0
    while quotient < 9 and bits.uint(1):
        quotient += 1
    if quotient == 9:
        return bits.uint(wide)
    if k == 1:
        return quotient
    value = quotient * m
    if bits.at + k > len(bits.bits):
        raise ended("Rice code")
    low = bits.uint(k)
    if low > 1:
        return value + low - 1
    bits.at -= 1  # the suffix is a bit shorter when it is 0
    return value


def rice_block(bits: Bits, n: int, wide: int, start: int, rate: int, limit: int) -> np.ndarray:
    """n residuals; the history begins at start, moves by rate and bounds k by limit."""
    out, i, history, sign = [0] * n, 0, start, 0
    raw, size, origin = np.packbits(bits.bits).tobytes() + bytes(8), len(bits.bits), bits.at
    zero, at = bits.next_zero_from(origin), origin

    def field(n_bits: int) -> int:
        return int.from_bytes(raw[at >> 3 : (at >> 3) + 8], "big") >> 64 - (at & 7) - n_bits & (1 << n_bits) - 1

    def scalar(k: int, wide: int) -> int:
        """As _scalar, from whole fields."""
        nonlocal at
        quotient = min(9, zero[at - origin] - at) if at < size else 9
        if quotient == 9:
            at += 9
            x, at = field(wide), at + wide
        else:
            at += quotient + 1
            x = quotient * ((1 << k) - 1)
            if k > 1:
                low = field(k)
                x, at = (x + low - 1, at + k) if low > 1 else (x, at + k - 1)
                if at + (low <= 1) > size:
                    raise ended("Rice code")
        if at > size:
            raise ended("bits")
        return x

    while i < n:
        x = scalar(min(limit, ((history >> 9) + 3).bit_length() - 1), wide) + sign
        out[i] = -(x + 1 >> 1) if x & 1 else x >> 1
        i, sign = i + 1, 0
        history = 0xFFFF if x > 0xFFFF else history + x * rate - (history * rate >> 9)
        if history < 128 and i < n:
            zeros = scalar(min(limit, 8 - history.bit_length() + (history + 16 >> 6)), 16)
            if i + zeros > n:
                raise bad_data("zero run past the frame")
            i += zeros
            sign = zeros < 0xFFFF
            history = 0
    bits.at = at
    return np.array(out, np.int64)


def _wrapped(x: int, depth: int) -> int:
    return (x + (1 << depth - 1)) % (1 << depth) - (1 << depth - 1)


def _predicted(given: list[int], coefficients: list[int], shift: int, depth: int, inverse: bool) -> list[int]:
    """Residuals to samples (inverse) or samples to residuals: one walk, as both adapt by the same errors.

    Each coefficient moves by the sign of the error left.
    """
    n, taps = len(coefficients), list(coefficients)
    samples: list[int] = []
    out: list[int] = []
    half = 1 << shift >> 1

    def take(x: int, guess: int) -> int:
        error = x if inverse else _wrapped(x - guess, depth)
        samples.append(_wrapped(x + guess, depth) if inverse else x)
        out.append(samples[-1] if inverse else error)
        return error

    for x in given:
        k = len(samples)
        if k == 0:
            take(x, 0)
        elif k <= n or n == 31:
            take(x, samples[-1])
        else:
            base = samples[-n - 1]
            diffs = [s - base for s in samples[: -n - 1 : -1]]
            error = take(x, base + (sum(c * d for c, d in zip(taps, diffs, strict=True)) + half >> shift))
            if error:
                side = 1 if error > 0 else -1
                for j in range(n - 1, -1, -1):
                    d = -diffs[j]
                    taps[j] -= side * ((d > 0) - (d < 0))
                    error -= (abs(d) * side >> shift) * (n - j)
                    if error * side <= 0:
                        break
    return out


def unfilter(residual: np.ndarray, coefficients: list[int], shift: int, depth: int) -> np.ndarray:
    """Samples from residuals of the adaptive predictor; 31 coefficients stand for plain differences."""
    return np.array(_predicted(residual.tolist(), coefficients, shift, depth, True), np.int64) if coefficients else residual


@dataclass
class Filtered:
    """A channel's residuals, not restored yet."""

    residual: np.ndarray
    taps: list[int]
    shift: int
    depth: int


def _in_step(parts: list[Filtered]) -> list[np.ndarray]:
    """unfilter of channels of one length, order, shift and depth, sample by sample, all of them at once."""
    given, order, shift = np.stack([p.residual for p in parts], axis=1), len(parts[0].taps), parts[0].shift
    half, low, span = 1 << shift >> 1, 1 << parts[0].depth - 1, (1 << parts[0].depth) - 1
    taps, out = np.array([p.taps for p in parts], np.int64).T.copy(), np.empty_like(given)
    out[:1] = given[:1]
    for t in range(1, len(given)):
        error = given[t]
        if t <= order:
            out[t] = (error + out[t - 1] + low & span) - low
            continue
        base = out[t - order - 1]
        diffs = out[t - order : t][::-1] - base
        out[t] = (error + base + ((taps * diffs).sum(0) + half >> shift) + low & span) - low
        side = np.sign(error)
        moves, steps = np.sign(diffs), (np.abs(diffs) * side >> shift) * np.arange(order, 0, -1)[:, None]
        for j in range(order - 1, -1, -1):
            moving = error * side > 0
            if not moving.any():
                break
            taps[j] += np.where(moving, side * moves[j], 0)
            error = np.where(moving, error - steps[j], error)
    return list(np.ascontiguousarray(out.T))


def restored(parts: list[Filtered]) -> list[np.ndarray]:
    """Samples of all channels; like ones go in step where they are enough."""
    out: list = [None] * len(parts)
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(parts):
        groups.setdefault((len(p.residual), len(p.taps), p.shift, p.depth), []).append(i)
    for (n, order, _, depth), own in groups.items():
        some = [parts[i] for i in own]
        in_step = len(some) >= FEW and n and 0 < order < 31 and depth < 33
        values = _in_step(some) if in_step else [unfilter(p.residual, p.taps, p.shift, p.depth) for p in some]
        for i, v in zip(own, values, strict=True):
            out[i] = v
    return out


def filtered(samples: np.ndarray, coefficients: list[int], shift: int, depth: int) -> np.ndarray:
    """The residuals."""
    return np.array(_predicted(samples.tolist(), coefficients, shift, depth, False), np.int64) if coefficients else samples


def write_scalar(sink: BitSink, x: int, k: int, wide: int) -> None:
    quotient, rest = divmod(x, (1 << k) - 1)
    if quotient > 8:
        sink.uint((1 << 9) - 1, 9)
        sink.uint(x, wide)
        return
    sink.uint((1 << quotient) - 1 << 1, quotient + 1)
    if k > 1:
        sink.uint(rest + 1, k) if rest else sink.uint(0, k - 1)


def write_rice_block(sink: BitSink, values: list[int], wide: int, start: int, rate: int, limit: int) -> None:
    """The inverse of rice_block."""
    history, sign, i = start, 0, 0
    while i < len(values):
        x = 2 * values[i] if values[i] >= 0 else -2 * values[i] - 1
        write_scalar(sink, x - sign, min(limit, ((history >> 9) + 3).bit_length() - 1), wide)
        i, sign = i + 1, 0
        history = 0xFFFF if x > 0xFFFF else history + x * rate - (history * rate >> 9)
        if history < 128 and i < len(values):
            run = next((j for j, v in enumerate(values[i : i + 0xFFFF]) if v), min(len(values) - i, 0xFFFF))
            write_scalar(sink, run, min(limit, 8 - history.bit_length() + (history + 16 >> 6)), 16)
            i, sign, history = i + run, int(run < 0xFFFF), 0


def write_element(sink: BitSink, planes: list[np.ndarray], c: Config, coefficients: list[int], shift: int, mix_bits: int = 2, mix: int = 0) -> None:
    """A compressed element of one or two channels as long as the cookie's frame."""
    channels = len(planes)
    depth = c.bit_depth + channels - 1
    sink.uint(PAIR if channels == 2 else SINGLE, 3)
    sink.uint(0, 4 + 12 + 1 + 2 + 1)
    sink.uint(mix_bits, 8)
    sink.uint(mix & 0xFF, 8)
    for _ in planes:
        sink.uint(shift, 8)
        sink.uint(4, 3)
        sink.uint(len(coefficients), 5)
        sink.array(np.array(coefficients, np.int64), 16)
    if mix and channels == 2:
        v = planes[0] - planes[1]
        planes = [planes[1] + (mix * v >> mix_bits), v]
    for p in planes:
        write_rice_block(sink, filtered(p, coefficients, shift, depth).tolist(), depth, c.mb, c.pb, c.kb)


def unmix(u: np.ndarray, v: np.ndarray, bits: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
    if not weight:
        return u, v
    left = u + v - (weight * v >> bits)
    return left, left - v


@dataclass
class Element:
    """Channels as residuals, and what makes samples of them once these are restored."""

    parts: list[Filtered]
    mix_bits: int
    mix: int
    shifted: int
    low: np.ndarray | None

    def planes(self, own: list[np.ndarray]) -> list[np.ndarray]:
        out = list(unmix(*own, self.mix_bits, self.mix)) if len(own) == 2 else own
        return [x << self.shifted | y for x, y in zip(out, self.low, strict=True)] if self.low is not None else out


def _element(bits: Bits, c: Config, channels: int) -> Element:
    bits.uint(12)
    partial, shifted, raw = bits.uint(1), bits.uint(2) * 8, bits.uint(1)
    n = bits.uint(32) if partial else c.frame_length
    if n > MOST_SAMPLES:
        raise bad_data(f"sample count {n} exceeds {MOST_SAMPLES}")
    if raw:
        own = bits.array(n * channels, c.bit_depth).reshape(n, channels).T
        return Element([Filtered(x, [], 0, c.bit_depth) for x in own], 0, 0, 0, None)
    depth = c.bit_depth - shifted + (channels - 1)
    if c.bit_depth - shifted <= 0:
        raise bad_data("shifted bytes exceed the bit depth")
    mix_bits, mix = bits.uint(8), bits.sint(8)
    params = []
    for _ in range(channels):
        mode, shift, factor, count = bits.uint(4), bits.uint(4), bits.uint(3), bits.uint(5)
        params.append((mode, shift, factor, bits.array(count, 16).tolist()))
    low = bits.array(n * channels, shifted, signed=False).reshape(n, channels).T if shifted else None
    out = []
    for mode, shift, factor, taps in params:
        r = rice_block(bits, n, depth, c.mb, c.pb * factor // 4, c.kb)
        if mode:
            r = unfilter(r, [1] * 31, 0, depth)
        out.append(Filtered(r, taps, shift, depth))
    return Element(out, mix_bits, mix if channels == 2 else 0, shifted, low)


def _elements(c: Config, data: bytes) -> list[Element]:
    bits, out = Bits(data), []
    while (tag := bits.uint(3)) != END:
        bits.uint(4)
        if tag not in (SINGLE, PAIR, LFE):
            raise bad_data(f"unsupported ALAC element tag: {tag}")
        out.append(_element(bits, c, 2 if tag == PAIR else 1))
    return out


def decode_frames(frames: list[tuple[Config, bytes]]) -> list[np.ndarray | AudioError]:
    """Interleaved f32 samples of each frame, or why there are none."""
    parsed: list[list[Element] | AudioError] = []
    for c, data in frames:
        try:
            parsed.append(_elements(c, data))
        except AudioError as e:
            parsed.append(e)
    done = iter(restored([p for x in parsed if not isinstance(x, AudioError) for e in x for p in e.parts]))
    out: list[np.ndarray | AudioError] = []
    for (c, _), elements in zip(frames, parsed, strict=True):
        if isinstance(elements, AudioError):
            out.append(elements)
            continue
        planes = [plane for e in elements for plane in e.planes([next(done) for _ in e.parts])]
        n = len(planes[0]) if planes else 0
        even = np.stack([np.pad(p[:n], (0, n - len(p[:n]))) for p in planes], axis=1) if planes else np.zeros(0)
        out.append((even / float(1 << (c.bit_depth - 1))).astype(np.float32).ravel())
    return out


def decode_frame(c: Config, data: bytes) -> np.ndarray:
    """Of one frame."""
    found = decode_frames([(c, data)])[0]
    if isinstance(found, AudioError):
        raise found
    return found


def decode_all(files: list[bytes]) -> list[Decoded | AudioError]:
    """Each file's cookie and frame, or why it can't be decoded; the files' recurrences go in step."""
    out: list[Decoded | AudioError] = []
    configs: list[Config | AudioError] = []
    for data in files:
        try:
            configs.append(config(data))
        except AudioError as e:
            configs.append(e)
    frames = iter(decode_frames([(c, data[24:]) for c, data in zip(configs, files, strict=True) if not isinstance(c, AudioError)]))
    for c in configs:
        found = c if isinstance(c, AudioError) else next(frames)
        out.append(found if isinstance(found, AudioError) else (info("Alac", c.sample_rate, c.num_channels, c.bit_depth, len(found) // c.num_channels), found))
    return out


def decode(data: bytes) -> Decoded:
    found = decode_all([data])[0]
    if isinstance(found, AudioError):
        raise found
    return found
