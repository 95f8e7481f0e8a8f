"""AIFF and AIFF-C (NONE, sowt): signed PCM of 8, 16, 24 and 32 bits."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np

from tonewright.sources.errors import AudioError, bad_data, bad_header
from tonewright.sources.info import Decoded, info
from tonewright.sources.pcm_bytes import from_bytes, to_bytes


def ext80_to_float(raw: bytes) -> float:
    head, mantissa = struct.unpack(">HQ", raw)
    value = math.ldexp(mantissa, (head & 0x7FFF) - 16446) if mantissa else 0.0
    return -value if head & 0x8000 else value


def float_to_ext80(x: float) -> bytes:
    if not x:
        return bytes(10)
    fraction, exponent = math.frexp(abs(x))
    return struct.pack(">HQ", (0x8000 if x < 0 else 0) | (exponent + 16382), int(math.ldexp(fraction, 64)))


@dataclass
class Layout:
    channels: int
    frames: int
    bits: int
    rate: int
    order: str
    start: int
    declared: int

    @property
    def width(self) -> int:
        return self.bits // 8

    def check(self) -> Layout:
        if not self.channels:
            raise AudioError("InvalidChannels", "0")
        if not self.rate:
            raise AudioError("InvalidSampleRate", "0")
        if self.bits not in (8, 16, 24, 32):
            raise bad_data(f"unsupported AIFF bit depth: {self.bits}")
        return self

    def samples(self, raw: bytes) -> np.ndarray:
        return from_bytes(raw, self.bits, self.order, unsigned8=False)


def layout(data: bytes) -> Layout | None:
    """From the chunks up to COMM and SSND; None if they aren't all there."""
    if len(data) < 12:
        return None
    if data[:4] != b"FORM":
        raise bad_header("missing FORM magic")
    if data[8:12] not in (b"AIFF", b"AIFC"):
        raise bad_header("missing AIFF/AIFC identifier")
    aifc, at, comm, body = data[8:12] == b"AIFC", 12, None, None
    while at + 8 <= len(data) and not (comm and body):
        name, size = struct.unpack_from(">4sI", data, at)
        if name == b"COMM":
            need = 22 if aifc else 18
            if size < need:
                raise bad_header("COMM chunk too small")
            if at + 8 + need > len(data):
                return None
            channels, frames, bits = struct.unpack_from(">HIH", data, at + 8)
            kind = data[at + 26 : at + 30] if aifc else b"NONE"
            if kind not in (b"NONE", b"sowt"):
                raise bad_data(f"unsupported AIFF-C compression: {kind.decode('latin-1')}")
            comm = channels, frames, bits, int(ext80_to_float(data[at + 16 : at + 26])), "<" if kind == b"sowt" else ">"
        elif name == b"SSND":
            if size < 8:
                raise bad_header("SSND chunk too small")
            if at + 16 > len(data):
                return None
            skip = struct.unpack_from(">I", data, at + 8)[0]
            if skip > size - 8:
                raise bad_header("SSND offset past its chunk")
            body = at + 16 + skip, size - 8 - skip
        at += 8 + size + size % 2
    return Layout(*comm, *body) if comm and body else None


def decode(data: bytes) -> Decoded:
    if len(data) < 12:
        raise bad_header("AIFF file too short")
    found = layout(data)
    if found is None:
        raise bad_header("missing COMM or SSND chunk")
    found.check()
    samples = found.samples(data[found.start : found.start + found.declared])
    return info("Aiff", found.rate, found.channels, found.bits, len(samples) // found.channels), samples


def encode(samples: np.ndarray, rate: int, channels: int, bits: int = 16) -> bytes:
    if channels <= 0:
        raise AudioError("InvalidChannels", str(channels))
    if rate <= 0:
        raise AudioError("InvalidSampleRate", str(rate))
    raw = to_bytes(samples, bits, ">", unsigned8=False)
    pad = b"\0" * (len(raw) % 2)
    comm = struct.pack(">hIh", channels, len(samples) // channels, bits) + float_to_ext80(rate)
    body = b"AIFF" + struct.pack(">4sI", b"COMM", 18) + comm + struct.pack(">4sIII", b"SSND", 8 + len(raw), 0, 0) + raw + pad
    return struct.pack(">4sI", b"FORM", len(body)) + body
