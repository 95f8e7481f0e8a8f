"""PCM sample conversions: of a column (a sample a row), or of an array column by each()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewright.functions.numeric import be, clamp, f32, joined, sign_extend, to_le, trunc

#: name -> (bytes, bits)
FORMATS = {"I8": (1, 8), "I16": (2, 16), "I24": (3, 24), "I32": (4, 32), "F32": (4, 32), "F64": (8, 64)}


def each(convert: Callable[[Column], Column], samples: Column) -> Column:
    return F.transform(samples, convert)


def _unit(s: Column) -> Column:
    return clamp(s.cast("float"), f32(-1), f32(1))


def i16_to_f32(s: Column) -> Column:
    return (s.cast("float") / f32(32768)).cast("float")


def f32_to_i16(s: Column) -> Column:
    return trunc(_unit(s) * f32(32767)).cast("smallint")


def i32_to_f32(s: Column) -> Column:
    return (s.cast("float") / f32(2147483648)).cast("float")


def f32_to_i32(s: Column) -> Column:
    return trunc(_unit(s).cast("double") * 2147483647.0)


def i24_to_f32(s: Column) -> Column:
    """From the low 24 bits of an integer."""
    return (sign_extend(s, 24).cast("float") / f32(8388608)).cast("float")


def f32_to_i24(s: Column) -> Column:
    return trunc(_unit(s) * f32(8388607))


def i24_packed_to_f32(packed: Column) -> Column:
    """BINARY of 3-byte little-endian groups to an array; a remainder is dropped."""
    n = F.floor(F.octet_length(packed) / 3).cast("int")
    one = lambda i: i24_to_f32(be(packed, i * 3, 1) + be(packed, i * 3 + 1, 1) * 256 + be(packed, i * 3 + 2, 1) * 65536)
    return F.when(n == 0, F.array().cast("array<float>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), one))


def f32_to_i24_packed(samples: Column) -> Column:
    """Array to BINARY."""
    hexes = F.transform(samples, lambda s: F.hex(to_le(f32_to_i24(s), 3)))
    return F.unhex(F.array_join(hexes, ""))


def f64_to_f32(s: Column) -> Column:
    return s.cast("float")


def f32_to_f64(s: Column) -> Column:
    return s.cast("double")


def u8_to_f32(s: Column) -> Column:
    return ((s.cast("float") - f32(128)) / f32(128)).cast("float")


def f32_to_u8(s: Column) -> Column:
    return trunc(clamp(_unit(s) * f32(128) + f32(128), f32(0), f32(255)))


def bytes_per_sample(fmt: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, (n, _) in FORMATS.items() for x in (k, n)])[fmt]


def bit_depth(fmt: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, (_, n) in FORMATS.items() for x in (k, n)])[fmt]


def interleave(planes: Column) -> Column:
    """Array of planes to frames; as many frames as the first plane has, short planes skipped where they end."""
    n = F.coalesce(F.size(F.get(planes, F.lit(0))), F.lit(0))
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(F.transform(planes, lambda p: F.get(p, i)), lambda s: s.isNotNull()))
    return F.when(n <= 0, F.array().cast("array<float>")).otherwise(F.flatten(frames))


def deinterleave(samples: Column, channels: Column) -> Column:
    """Frames to an array of planes; a partial last frame is dropped, no channel gives no plane."""
    n = F.when(channels > 0, F.floor(F.size(samples) / channels)).otherwise(0).cast("int")
    plane = lambda c: F.when(n == 0, F.array().cast("array<float>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(samples, i * channels + c)))
    return F.when(channels <= 0, F.array().cast("array<array<float>>")).otherwise(F.transform(F.sequence(F.lit(0), channels - 1), plane))


def raw_bytes(samples: Column, fmt: str) -> Column:
    """Array to little-endian BINARY of an integer format, JVM-side."""
    width = FORMATS[fmt][0]
    convert = {"I8": f32_to_u8, "I16": f32_to_i16, "I24": f32_to_i24, "I32": f32_to_i32}[fmt]
    return F.unhex(F.array_join(F.transform(samples, lambda s: F.hex(joined(to_le(convert(s), width)))), ""))
