"""RIFF/WAVE: PCM of 8 (unsigned), 16, 24 and 32 bits, IEEE float of 32, and EXTENSIBLE."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from tonewright.sources.errors import AudioError, bad_data, bad_header
from tonewright.sources.info import Decoded, info
from tonewright.sources.pcm_bytes import from_bytes, to_bytes

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
BITS = {"I8": 8, "I16": 16, "I24": 24, "I32": 32, "F32": 32}


@dataclass
class Layout:
    code: int
    channels: int
    rate: int
    bits: int
    start: int
    declared: int

    def check(self) -> Layout:
        if not self.channels:
            raise AudioError("InvalidChannels", "0")
        if not self.rate:
            raise AudioError("InvalidSampleRate", "0")
        if not (self.code == PCM and self.bits in (8, 16, 24, 32) or self.code == FLOAT and self.bits == 32):
            raise bad_data(f"unsupported WAV format: code={self.code}, bits={self.bits}")
        return self

    @property
    def width(self) -> int:
        return self.bits // 8

    def samples(self, raw: bytes) -> np.ndarray:
        if self.code == FLOAT:
            return np.frombuffer(raw[: len(raw) // 4 * 4], "<f4")
        return from_bytes(raw, self.bits)


def layout(data: bytes) -> Layout | None:
    """From the chunks up to fmt and data; None if they aren't all there."""
    if len(data) >= 12 and (data[:4] != b"RIFF" or data[8:12] != b"WAVE"):
        raise bad_header("missing RIFF magic" if data[:4] != b"RIFF" else "missing WAVE identifier")
    at, fmt, body = 12, None, None
    while at + 8 <= len(data) and not (fmt and body):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            if size < 16:
                raise bad_header("fmt chunk too small")
            if at + 8 + min(size, 40) > len(data):
                return None
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if code == EXTENSIBLE and size >= 40:
                valid, code = struct.unpack_from("<H", data, at + 26)[0], struct.unpack_from("<H", data, at + 32)[0]
                bits = valid or bits
            fmt = code, channels, rate, bits
        elif name == b"data":
            body = at + 8, size
        at += 8 + size + size % 2
    return Layout(*fmt, *body) if fmt and body else None


def decode(data: bytes) -> Decoded:
    if len(data) < 44:
        raise bad_header("WAV file too short")
    found = layout(data)
    if found is None:
        raise bad_header("missing fmt or data chunk")
    found.check()
    samples = found.samples(data[found.start : found.start + found.declared])
    return info("Wav", found.rate, found.channels, found.bits, len(samples) // found.channels), samples


def encode(samples: np.ndarray, rate: int, channels: int, fmt: str = "I16") -> bytes:
    """An odd data chunk gets its pad byte."""
    if channels <= 0:
        raise AudioError("InvalidChannels", str(channels))
    if rate <= 0:
        raise AudioError("InvalidSampleRate", str(rate))
    if fmt not in BITS:
        raise AudioError("EncodeError", f"{fmt} WAV encoding not supported")
    bits = BITS[fmt]
    raw = np.asarray(samples, "<f4").tobytes() if fmt == "F32" else to_bytes(samples, bits)
    align = channels * bits // 8
    pad = b"\0" * (len(raw) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(raw) + len(pad), b"WAVE", b"fmt ", 16, FLOAT if fmt == "F32" else PCM, channels, rate, align * rate, align, bits, b"data", len(raw))
    return head + raw + pad
