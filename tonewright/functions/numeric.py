"""Casts, clamps, shifts and byte access that follow the conventions of PCM code.

Float to int truncates and saturates and NaN is 0; f32 work stays FLOAT, as a DOUBLE literal would
widen it. Integers of files are read from BINARY columns by offset (from 0, a number or a column).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrInt = Column | int


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def f32(x: float) -> Column:
    return F.lit(x).cast("float")


def clamp(s: Column, low: Column, high: Column) -> Column:
    """Between low and high; NaN stays, as greatest and least would make it the largest."""
    return F.when(F.isnan(s), s).otherwise(F.greatest(low, F.least(high, s)))


def trunc(x: Column, kind: str = "int") -> Column:
    """Truncated; x must be in range or NaN, which is 0."""
    return F.when(F.isnan(x), F.lit(0).cast(kind)).otherwise(x.cast(kind))


def round_away(x: Column, kind: str = "int") -> Column:
    """Half away from zero."""
    return F.when(F.isnan(x), F.lit(0).cast(kind)).otherwise((F.signum(x) * F.floor(F.abs(x) + 0.5)).cast(kind))


def sign_extend(x: Column, bits: int) -> Column:
    """The low bits of x as two's complement (BIGINT)."""
    low = x.cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long")) if bits < 64 else x.cast("long")
    return F.shiftright(F.shiftleft(low, 64 - bits), 64 - bits)


def part(content: Column, at: ColumnOrInt, n: ColumnOrInt) -> Column:
    """n bytes from offset at (BINARY, shorter at the end)."""
    return F.substring(content, (col(at) + 1).cast("int"), col(n).cast("int"))


def be(content: Column, at: ColumnOrInt, n: int) -> Column:
    """Unsigned big-endian integer of n (up to 7) bytes; null past the end."""
    raw = part(content, at, n)
    return F.when(F.octet_length(raw) == n, F.conv(F.hex(raw), 16, 10).cast("long"))


def le(content: Column, at: ColumnOrInt, n: int) -> Column:
    total = F.lit(0).cast("long")
    for i in range(n):
        total = total + F.shiftleft(be(content, col(at) + i, 1), 8 * i)
    return total


def bits(x: Column, shift: int, n: int) -> Column:
    return F.shiftright(x, shift).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def to_be(x: Column, n: int) -> Column:
    """The low n bytes (up to 8) of an integer, BINARY."""
    full = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.substring(full, 17 - 2 * n, 2 * n))


def to_le(x: Column, n: int) -> Column:
    return joined(*[to_be(F.shiftright(x.cast("long"), 8 * i), 1) for i in range(n)])


def joined(*parts: Column) -> Column:
    return F.concat(*parts)


def text(s: str) -> Column:
    return F.lit(bytearray(s.encode("latin-1")))


def lookup(index: Column, values: list) -> Column:
    """values[index] as one literal; null outside."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def syncsafe(content: Column, at: ColumnOrInt, mask: bool = True) -> Column:
    """Four bytes of seven bits; without mask bit 7 of each spills over."""
    total = F.lit(0).cast("long")
    for i in range(4):
        b = be(content, col(at) + i, 1)
        total = total.bitwiseOR(F.shiftleft(b.bitwiseAND(F.lit(0x7F).cast("long")) if mask else b, 21 - 7 * i))
    return total


def ext80_to_double(content: Column, at: ColumnOrInt = 0) -> Column:
    """80-bit extended float: 15-bit exponent biased by 16383 and a 64-bit mantissa with a visible one."""
    head = be(content, at, 2)
    exponent = head.bitwiseAND(F.lit(0x7FFF).cast("long"))
    mantissa = be(content, col(at) + 2, 4).cast("double") * 4294967296.0 + be(content, col(at) + 6, 4).cast("double")
    value = mantissa * F.pow(F.lit(2.0), (exponent - 16446).cast("double"))
    return F.when((exponent == 0) & (mantissa == 0), F.lit(0.0)).otherwise(F.when(bits(head, 15, 1) == 1, -value).otherwise(value))


def double_to_ext80(x: Column) -> Column:
    """Of a finite number; the mantissa is exact, as a double has 53 bits."""
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    exponent = F.when(F.pow(F.lit(2.0), guess.cast("double")) > size, guess - 1).when(F.pow(F.lit(2.0), (guess + 1).cast("double")) <= size, guess + 1).otherwise(guess)
    scaled = size * F.pow(F.lit(2.0), (F.lit(31) - exponent).cast("double"))
    high = F.floor(scaled)
    low = F.floor((scaled - high) * 4294967296.0)
    sign = F.when(x < 0, F.lit(0x8000)).otherwise(F.lit(0))
    return F.when(size == 0, F.lit(bytearray(10))).otherwise(joined(to_be(exponent + 16383 + sign, 2), to_be(high, 4), to_be(low, 4)))
