"""What every decoder returns: FormatInfo and interleaved f32 samples."""

from __future__ import annotations

from dataclasses import astuple, dataclass

import numpy as np

INFO_TYPE = "struct<format:string,sample_rate:int,channels:int,bit_depth:int,duration_secs:double,total_samples:bigint>"
ERROR_TYPE = "struct<code:string,detail:string>"


@dataclass
class FormatInfo:
    """total_samples counts frames: samples of each channel."""

    format: str
    sample_rate: int
    channels: int
    bit_depth: int
    duration_secs: float
    total_samples: int

    def row(self) -> tuple:
        return astuple(self)


def info(kind: str, rate: int, channels: int, bits: int, frames: int) -> FormatInfo:
    return FormatInfo(kind, rate, channels, bits, frames / rate if rate else 0.0, frames)


Decoded = tuple[FormatInfo, np.ndarray]
NO_SAMPLES = np.zeros(0, np.float32)
