"""AAC in ADTS: frames and their properties on reading (payloads are not decoded), an analysis packer on writing.

The encoder writes one long-window mono element a frame with 48 kHz bands at every rate, plain 9-bit
pairs in place of spectral Huffman codes and no overlap: its analysis stages are of use, its stream
is not for decoders.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tonewright.functions.headers import AAC_CHANNELS, AAC_RATES
from tonewright.sources.bits import BitSink
from tonewright.sources.errors import AudioError, bad_header
from tonewright.sources.info import NO_SAMPLES, Decoded, info
from tonewright.sources.transform import mdct_ref, sine_window

FRAME = 1024
# Fixed values of ISO 13818-7: scale factor bands at 48 kHz.
BANDS = [
    0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 48, 56, 64, 72, 80, 88, 96, 108, 120, 132, 144, 160, 176, 196, 216, 240, 264, 292, 320, 352,
    384, 416, 448, 480, 512, 544, 576, 608, 640, 672, 704, 736, 768, 800, 832, 864, 896, 928, 1024,
]
# Fixed values of ISO 13818-7, table A.1: lengths and codes of scale factor differences from -60 to 60.
SCALE_LENGTHS = [
    18, 18, 18, 18, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 18, 19, 18, 17, 17, 16, 17, 16, 16, 16, 16, 15, 15, 14,
    14, 14, 14, 14, 14, 13, 13, 12, 12, 12, 11, 12, 11, 10, 10, 10, 9, 9, 8, 8, 8, 7, 6, 6, 5, 4, 3, 1, 4, 4, 5, 6, 6, 7, 7, 8, 8, 9, 9,
    10, 10, 10, 11, 11, 11, 11, 12, 12, 13, 13, 13, 14, 14, 16, 15, 16, 15, 18, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19,
    19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19, 19,
]
SCALE_CODES = [
    0x3FFE8, 0x3FFE6, 0x3FFE7, 0x3FFE5, 0x7FFF5, 0x7FFF1, 0x7FFED, 0x7FFF6, 0x7FFEE, 0x7FFEF, 0x7FFF0, 0x7FFFC, 0x7FFFD, 0x7FFFF,
    0x7FFFE, 0x7FFF7, 0x7FFF8, 0x7FFFB, 0x7FFF9, 0x3FFE4, 0x7FFFA, 0x3FFE3, 0x1FFEF, 0x1FFF0, 0x0FFF5, 0x1FFEE, 0x0FFF2, 0x0FFF3,
    0x0FFF4, 0x0FFF1, 0x07FF6, 0x07FF7, 0x03FF9, 0x03FF5, 0x03FF7, 0x03FF3, 0x03FF6, 0x03FF2, 0x01FF7, 0x01FF5, 0x00FF9, 0x00FF7,
    0x00FF6, 0x007F9, 0x00FF4, 0x007F8, 0x003F9, 0x003F7, 0x003F5, 0x001F8, 0x001F7, 0x000FA, 0x000F8, 0x000F6, 0x00079, 0x0003A,
    0x00038, 0x0001A, 0x0000B, 0x00004, 0x00000, 0x0000A, 0x0000C, 0x0001B, 0x00039, 0x0003B, 0x00078, 0x0007A, 0x000F7, 0x000F9,
    0x001F6, 0x001F9, 0x003F4, 0x003F6, 0x003F8, 0x007F5, 0x007F4, 0x007F6, 0x007F7, 0x00FF5, 0x00FF8, 0x01FF4, 0x01FF6, 0x01FF8,
    0x03FF8, 0x03FF4, 0x0FFF0, 0x07FF4, 0x0FFF6, 0x07FF5, 0x3FFE2, 0x7FFD9, 0x7FFDA, 0x7FFDB, 0x7FFDC, 0x7FFDD, 0x7FFDE, 0x7FFD8,
    0x7FFD2, 0x7FFD3, 0x7FFD4, 0x7FFD5, 0x7FFD6, 0x7FFF2, 0x7FFDF, 0x7FFE7, 0x7FFE8, 0x7FFE9, 0x7FFEA, 0x7FFEB, 0x7FFE6, 0x7FFE0,
    0x7FFE1, 0x7FFE2, 0x7FFE3, 0x7FFE4, 0x7FFE5, 0x7FFD7, 0x7FFEC, 0x7FFF4, 0x7FFF3,
]


@dataclass
class Frame:
    at: int
    profile: int
    sample_rate: int
    channels: int
    frame_length: int
    header_size: int


def header(data: bytes, at: int = 0) -> Frame:
    raw = data[at : at + 7]
    w = int.from_bytes(raw, "big")
    if len(raw) < 7 or w >> 44 != 0xFFF:
        raise bad_header("missing ADTS sync word")
    if w >> 41 & 3:
        raise bad_header("ADTS layer must be 0")
    rate, config, length = w >> 34 & 15, w >> 30 & 7, w >> 13 & 0x1FFF
    if rate >= len(AAC_RATES):
        raise bad_header(f"reserved sample rate index: {rate}")
    if not config:
        raise AudioError("InvalidChannels", "0")
    if length < 7:
        raise bad_header("frame length too small")
    return Frame(at, w >> 38 & 3, AAC_RATES[rate], AAC_CHANNELS[config], length, 7 if w >> 40 & 1 else 9)


def frames(data: bytes) -> list[Frame]:
    """Frames with a payload, and the first in any case; a cut last frame is left out, a bad header ends with an error."""
    out, first, at = [], None, 0
    while 0 <= (at := data.find(b"\xff", at)) <= len(data) - 7:
        if data[at + 1] & 0xF0 != 0xF0:
            at += 1
            continue
        found = header(data, at)
        if at + found.frame_length > len(data):
            break
        first = first or found
        if found.frame_length > found.header_size:
            out.append(found)
        at += found.frame_length
    if first is None:
        raise bad_header("no valid ADTS frames found")
    return out


def decode(data: bytes) -> Decoded:
    """Properties and length; payloads need a decoder that isn't here, so no samples."""
    found = frames(data)
    if not found:
        raise AudioError("DecodeError", "no AAC frames in the ADTS stream")
    return info("Aac", found[0].sample_rate, found[0].channels, 16, FRAME * len(found)), NO_SAMPLES


def write_header(rate: int, channels: int, payload: int) -> bytes:
    index = AAC_RATES.index(rate) if rate in AAC_RATES else 4
    return (0xFFF1 << 40 | 1 << 38 | index << 34 | channels << 30 | payload + 7 << 13 | 0x1FFC).to_bytes(7, "big")


def band_scales(bins: np.ndarray) -> np.ndarray:
    """Scale factors (frames, bands): from the RMS of a band, truncated, from 0 to 200; 0 for silence."""
    edges = np.array(BANDS)
    rms = np.sqrt(np.add.reduceat(bins * bins, edges[:-1], axis=-1) / np.diff(edges))
    with np.errstate(divide="ignore"):
        scale = np.trunc(100 + 4 * (np.log2(rms) - np.log2(10 / 128)))
    return np.clip(np.where(rms > 1e-10, scale, 0), 0, 200).astype(int)


def quantise(bins: np.ndarray, scales: np.ndarray) -> np.ndarray:
    step = 2.0 ** (0.25 * (np.repeat(scales, np.diff(BANDS), axis=-1) - 100))
    q = np.minimum(np.floor(np.abs(bins) ** 0.75 / step + 0.5), 8191)
    return np.where(bins >= 0, q, -q).astype(int)


def sections(used: np.ndarray) -> list[tuple[bool, int]]:
    """Runs of bands that are used or not."""
    edges = np.flatnonzero(np.diff(used)) + 1
    return [(bool(part[0]), len(part)) for part in np.split(used, edges)]


def pack_frame(scales: np.ndarray, q: np.ndarray, least: int) -> bytes:
    sink = BitSink()
    used = np.add.reduceat(np.abs(q), BANDS[:-1]) > 0
    sink.uint(0, 11)  # single channel element, its tag, long sine window
    sink.uint(len(scales), 6)
    sink.uint(0, 1)
    for is_used, run in sections(used):
        sink.uint(11 if is_used else 0, 4)
        for _ in range(run // 31):
            sink.uint(31, 5)
        sink.uint(run % 31, 5)
    sink.uint(int(scales[0]), 8)
    before = int(scales[0])
    for s in scales[used].tolist():
        k = min(120, max(0, s - before + 60))
        sink.uint(SCALE_CODES[k], SCALE_LENGTHS[k])
        before = s
    for b in np.flatnonzero(used):
        for x, y in q[BANDS[b] : BANDS[b + 1]].reshape(-1, 2).tolist():
            sink.uint(min(abs(x), 16) * 17 + min(abs(y), 16), 9)
            for v in (x, y):
                if v:
                    sink.uint(int(v < 0), 1)
            for v in (abs(x), abs(y)):
                if v >= 16:
                    n = max(4, (v - 16).bit_length())
                    sink.uint(n - 4, 4)
                    sink.uint(v - 16, n)
    sink.uint(7, 3)
    return sink.bytes().ljust(least, b"\0")


def spectrum(samples: np.ndarray, channels: int) -> np.ndarray:
    """Bins (frames, 1024) of mono frames of 1024, each followed by as many zeros."""
    n = len(samples) // channels
    mono = np.asarray(samples[: n * channels], np.float32).reshape(n, channels).mean(axis=1)
    count = max(1, -(-n // FRAME))
    frames_ = np.pad(mono, (0, count * FRAME - n)).reshape(count, FRAME)
    return mdct_ref(np.pad(frames_, ((0, 0), (0, FRAME))) * sine_window(2 * FRAME))


def encode(samples: np.ndarray, rate: int, channels: int, bitrate: int = 128000) -> bytes:
    if rate not in AAC_RATES:
        raise AudioError("InvalidSampleRate", str(rate))
    if channels not in (1, 2):
        raise AudioError("InvalidChannels", str(channels))
    if bitrate <= 0:
        raise AudioError("EncodeError", "bitrate must be > 0")
    least = max(20, int(bitrate / 8 / (rate / FRAME)))
    bins = spectrum(samples, channels)
    scales = band_scales(bins)
    packed = [pack_frame(s, q, least) for s, q in zip(scales, quantise(bins, scales), strict=True)]
    return b"".join(write_header(rate, channels, len(p)) + p for p in packed)
