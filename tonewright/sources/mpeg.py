"""MPEG audio frame headers: a scan of a file without decoding."""

from __future__ import annotations

from dataclasses import dataclass

from tonewright.functions.headers import MPEG1_L3_KBIT, MPEG2_L3_KBIT, MPEG_RATES
from tonewright.sources.errors import bad_header
from tonewright.sources.info import NO_SAMPLES, Decoded, info

MODES = ("Stereo", "JointStereo", "DualChannel", "Mono")


@dataclass
class Frame:
    at: int
    version: str
    layer: str
    bitrate: int
    sample_rate: int
    channel_mode: str
    frame_size: int
    samples_per_frame: int
    padding: bool


def header(data: bytes, at: int = 0) -> Frame | None:
    if at + 4 > len(data):
        return None
    w = int.from_bytes(data[at : at + 4], "big")
    version, layer, rate = w >> 19 & 3, w >> 17 & 3, w >> 10 & 3
    if w >> 21 != 0x7FF or version == 1 or layer == 0 or rate == 3:
        return None
    low3 = version != 3 and layer == 1
    kbit = (MPEG2_L3_KBIT if low3 else MPEG1_L3_KBIT)[w >> 12 & 15]
    if not kbit:
        return None
    hz, pad = MPEG_RATES[version][rate], w >> 9 & 1
    size = (12000 * kbit // hz + pad) * 4 if layer == 3 else (576 if low3 else 1152) * kbit * 125 // hz + pad
    spf = 384 if layer == 3 else 576 if low3 else 1152
    return Frame(at, {3: "V1", 2: "V2", 0: "V25"}[version], {3: "I", 2: "II", 1: "III"}[layer], kbit, hz, MODES[w >> 6 & 3], size, spf, bool(pad))


def skip_id3(data: bytes) -> int:
    if len(data) < 10 or data[:3] != b"ID3":
        return 0
    a, b, c, d = data[6:10]
    return 10 + (a << 21 | b << 14 | c << 7 | d)


def scan(data: bytes) -> list[Frame]:
    """Frames by hopping from one to the next; looks for the next header byte by byte where there is none."""
    out, at = [], skip_id3(data)
    while 0 <= (at := data.find(b"\xff", at)) <= len(data) - 4:
        found = header(data, at)
        if found:
            out.append(found)
        at += found.frame_size if found else 1
    if not out:
        raise bad_header("no valid MP3 frames found")
    return out


def decode(data: bytes) -> Decoded:
    found = scan(data)
    n = sum(f.samples_per_frame for f in found)
    return info("Mp3", found[0].sample_rate, 1 if found[0].channel_mode == "Mono" else 2, 16, n), NO_SAMPLES
