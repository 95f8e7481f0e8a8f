"""Samples to bytes of integer and float formats, and back, by whole arrays."""

from __future__ import annotations

import numpy as np

from tonewright.sources.errors import AudioError, bad_data


def quantised(samples: np.ndarray, bits: int) -> np.ndarray:
    """Truncated to integers; f32 arithmetic up to 24 bits, f64 for 32. NaN is 0."""
    s = np.nan_to_num(np.clip(np.asarray(samples, np.float32), np.float32(-1), np.float32(1)), nan=0.0)
    if bits == 32:
        return np.trunc(s.astype(np.float64) * 2147483647.0).astype(np.int64)
    return np.trunc(s * np.float32((1 << (bits - 1)) - 1)).astype(np.int64)


def to_bytes(samples: np.ndarray, bits: int, order: str = "<", unsigned8: bool = True) -> bytes:
    if bits == 8 and unsigned8:
        s = np.nan_to_num(np.clip(np.asarray(samples, np.float32), np.float32(-1), np.float32(1)), nan=-1.0)
        return np.trunc(np.clip(s * np.float32(128) + np.float32(128), 0, 255)).astype(np.uint8).tobytes()
    if bits not in (8, 16, 24, 32):
        raise AudioError("EncodeError", f"unsupported bit depth: {bits}")
    values = quantised(samples, bits)
    if bits == 24:
        raw = values.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]
        return (raw if order == "<" else raw[:, ::-1]).tobytes()
    return values.astype(f"{order}i{bits // 8}").tobytes()


def from_bytes(raw: bytes, bits: int, order: str = "<", unsigned8: bool = True) -> np.ndarray:
    """f32 samples; bytes of an incomplete last sample are dropped."""
    if bits not in (8, 16, 24, 32):
        raise bad_data(f"unsupported bit depth: {bits}")
    n = len(raw) // (bits // 8)
    raw = raw[: n * (bits // 8)]
    if bits == 8:
        v = np.frombuffer(raw, np.uint8).astype(np.float32) - np.float32(128) if unsigned8 else np.frombuffer(raw, np.int8).astype(np.float32)
        return v / np.float32(128)
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        b = b if order == "<" else b[:, ::-1]
        wide = np.zeros((n, 4), np.uint8)
        wide[:, 1:] = b
        return (wide.view("<i4").ravel() >> 8).astype(np.float32) / np.float32(8388608)
    return np.frombuffer(raw, f"{order}i{bits // 8}").astype(np.float32) / np.float32(1 << (bits - 1))
