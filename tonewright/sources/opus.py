"""Opus in Ogg (RFC 6716, 7845): headers and length on reading; a container with a plain CELT-like packet on writing.

Reading returns no samples. The encoder is an analysis, not a faithful CELT stream: a mono downmix,
a sine window, the transform over the frame without overlap, band energies and signs by a range coder.
"""

from __future__ import annotations

import struct

import numpy as np

from tonewright.sources import ogg
from tonewright.sources.errors import AudioError, bad_header, ended
from tonewright.sources.info import NO_SAMPLES, Decoded, FormatInfo
from tonewright.sources.transform import mdct_ref, sine_window

FRAME, PRE_SKIP, SERIAL = 960, 312, 0x746F6E65
# Band edges in bins of a 20 ms frame.
BAND_EDGES = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 17, 21, 26, 32, 40, 50, 62, 78, 100, 480]


def head(packet: bytes) -> dict[str, int]:
    if len(packet) < 19 or packet[:8] != b"OpusHead":
        raise bad_header("OpusHead")
    names = ("version", "channel_count", "pre_skip", "input_sample_rate", "output_gain", "channel_mapping_family")
    found = dict(zip(names, struct.unpack("<BBHIhB", packet[8:19]), strict=True))
    if not found["channel_count"]:
        raise AudioError("InvalidChannels", "0")
    return found


def described(packets: list[bytes], pages: list[ogg.Page]) -> Decoded:
    found = head(packets[0])
    granule = max((p for p in pages), key=lambda p: p.at).granule
    n = max(0, granule - found["pre_skip"])
    return FormatInfo("Opus", 48000, found["channel_count"], 16, n / 48000, n), NO_SAMPLES


def decode(data: bytes) -> Decoded:
    pages = ogg.pages(data)
    packets = ogg.packets_of(pages)
    if not packets:
        raise ended("no packet")
    return described(packets, pages)


class RangeEncoder:
    """The range coder of RFC 6716, section 5.1."""

    TOP, BOTTOM = 1 << 31, 1 << 23

    def __init__(self):
        self.low, self.range, self.carry, self.held, self.out = 0, self.TOP, -1, 0, bytearray()

    def _put(self, symbol: int) -> None:
        if symbol == 0xFF:
            self.held += 1
            return
        up = symbol >> 8
        if self.carry >= 0:
            self.out.append(self.carry + up & 0xFF)
        self.out += bytes([0xFF + up & 0xFF]) * self.held
        self.held, self.carry = 0, symbol & 0xFF

    def encode(self, low: int, high: int, total: int) -> None:
        step = self.range // total
        if low:
            self.low += self.range - step * (total - low)
            self.range = step * (high - low)
        else:
            self.range -= step * (total - high)
        while self.range <= self.BOTTOM:
            self._put(self.low >> 23)
            self.low = self.low << 8 & self.TOP - 1
            self.range <<= 8

    @property
    def size(self) -> int:
        return len(self.out) + (self.carry >= 0) + self.held

    def finish(self) -> bytes:
        """As few bytes as tell the interval."""
        shift = 31 - self.range.bit_length()
        mask = self.TOP - 1 >> shift + 1
        end = self.low + mask & ~mask
        if end | mask >= self.low + self.range:
            mask >>= 1
            end = self.low + mask & ~mask
        bits = shift + 2
        while bits > 0:
            self._put(end >> 23)
            end = end << 8 & self.TOP - 1
            bits -= 8
        if self.carry >= 0 or self.held:
            self._put(0)
            if self.held:
                self._put(0)
        return bytes(self.out)


class RangeDecoder:
    """Its inverse, section 4.1; for checks."""

    def __init__(self, data: bytes):
        self.data, self.at, self.range = data, 0, 128
        self.rest = self._next()
        self.value = 127 - (self.rest >> 1)
        self._fill()

    def _next(self) -> int:
        self.at += 1
        return self.data[self.at - 1] if self.at <= len(self.data) else 0

    def _fill(self) -> None:
        while self.range <= 1 << 23:
            self.range <<= 8
            byte = self._next()
            self.value = ((self.value << 8) + (255 & ~(((self.rest << 8 | byte) >> 1) & 255))) & (1 << 31) - 1
            self.rest = byte

    def decode(self, widths: list[int]) -> int:
        """The symbol among consecutive widths."""
        total = sum(widths)
        step = self.range // total
        place = total - min(self.value // step + 1, total)
        low = 0
        for symbol, w in enumerate(widths):
            if place < low + w:
                break
            low += w
        high = low + widths[symbol]
        self.value -= step * (total - high)
        self.range = step * (high - low) if low else self.range - step * (total - high)
        self._fill()
        return symbol


def band_energies(bins: np.ndarray) -> np.ndarray:
    """log2 of the mean square of each band (frames, bands), at least 1e-10."""
    edges = np.array(BAND_EDGES)
    power = np.add.reduceat(np.asarray(bins, float) ** 2, edges[:-1], axis=-1)
    return np.log2(np.maximum(power / np.diff(edges), 1e-10))


def energy_symbols(energies: np.ndarray) -> np.ndarray:
    """Half steps, as differences to the band below, from 0 to 127."""
    q = (np.sign(energies) * np.floor(np.abs(2 * energies) + 0.5)).astype(int)
    return np.clip(np.diff(q, axis=-1, prepend=0), -64, 63) + 64


def pack_frame(symbols: np.ndarray, bins: np.ndarray, size: int) -> bytes:
    coder = RangeEncoder()
    for s in symbols.tolist():
        coder.encode(s, s + 1, 128)
    for b in (bins >= 0).tolist():  # signs, until the bytes are used
        if coder.size >= size - 4:
            break
        coder.encode(int(b), int(b) + 1, 2)
    return (bytes([30 << 3]) + coder.finish())[:size].ljust(size, b"\0")  # TOC: CELT, full band, 20 ms, mono


def frames_of(samples: np.ndarray, channels: int) -> np.ndarray:
    """Mono frames of 960, the last filled with zeros; silence for no samples."""
    n = len(samples) // channels
    mono = np.asarray(samples[: n * channels], np.float32).reshape(n, channels).mean(axis=1, dtype=np.float32)
    count = max(1, -(-n // FRAME))
    return np.pad(mono, (0, count * FRAME - n)).reshape(count, FRAME)


def encode(samples: np.ndarray, rate: int, channels: int, bitrate: int = 64000) -> bytes:
    if rate != 48000:
        raise AudioError("InvalidSampleRate", str(rate))
    if channels not in (1, 2):
        raise AudioError("InvalidChannels", str(channels))
    if not 32000 <= bitrate <= 256000:
        raise AudioError("EncodeError", f"bitrate must be 32000..=256000, got {bitrate}")
    size, n = max(10, bitrate // 400), len(samples) // channels
    bins = mdct_ref(frames_of(samples, channels) * sine_window(FRAME))
    symbols = energy_symbols(band_energies(bins))
    packets = [pack_frame(s, b, size) for s, b in zip(symbols, bins, strict=True)]
    granules = [PRE_SKIP + min((k + 1) * FRAME, n) for k in range(len(packets))]
    opus_head = b"OpusHead" + struct.pack("<BBHIhB", 1, channels, PRE_SKIP, rate, 0, 0)
    vendor = b"tonewright"
    tags = b"OpusTags" + struct.pack("<I", len(vendor)) + vendor + bytes(4)
    return ogg.mux([opus_head, tags], [0, 0], SERIAL, finish=False) + ogg.mux(packets, granules, SERIAL, first=2, begin=False)
