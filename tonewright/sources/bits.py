"""Bit fields and check sums over numpy arrays."""

from __future__ import annotations

from functools import cache

import numpy as np

from tonewright.sources.errors import ended


class Bits:
    """Reads most significant bits first."""

    def __init__(self, data: bytes, at: int = 0):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 8 * at
        self._ones: np.ndarray | None = None

    def uint(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise ended("bits")
        value = 0
        for b in self.bits[self.at : self.at + n].tolist():
            value = value << 1 | b
        self.at += n
        return value

    def sint(self, n: int) -> int:
        value = self.uint(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def array(self, count: int, n: int, signed: bool = True) -> np.ndarray:
        """count integers of n bits."""
        if self.at + count * n > len(self.bits):
            raise ended("bits")
        if not n:
            return np.zeros(count, np.int64)
        rows = self.bits[self.at : self.at + count * n].reshape(count, n)
        self.at += count * n
        out = np.zeros(count, np.int64)
        for k in range(n):
            out = out << 1 | rows[:, k]
        return out - ((out >> (n - 1)) << n) if signed else out

    @property
    def next_one(self) -> np.ndarray:
        """For each bit, the place of the next 1 from there; the number of bits if there is none."""
        if self._ones is None:
            n = len(self.bits)
            at = np.flatnonzero(self.bits)
            self._ones = np.repeat(np.append(at, n), np.diff(at, prepend=-1, append=n))
        return self._ones

    def next_zero_from(self, at: int) -> list[int]:
        """For each bit from there, the place of the next 0; the number of bits if there is none."""
        n = len(self.bits)
        zeros = np.flatnonzero(self.bits[at:] == 0) + at
        return np.repeat(np.append(zeros, n), np.diff(zeros, prepend=at - 1, append=n)).tolist()

    def unary(self) -> int:
        """Zeros before a 1."""
        one = int(self.next_one[self.at])
        if one >= len(self.bits):
            raise ended("unary")
        n, self.at = one - self.at, one + 1
        return n

    def rice(self, count: int, k: int) -> np.ndarray:
        """count Rice codes of parameter k, as signed values."""
        if not count:
            return np.zeros(0, np.int64)
        ones, size, room = self.next_one, len(self.bits), 64 + count * (k + 2) * 5 // 4
        while True:  # over so many bits as the codes are likely to take, and twice as many until they fit
            end = min(size, self.at + room)
            jump = (np.minimum(ones[self.at : end + 1] + (1 + k), end + 1) - self.at).astype(np.intp)
            starts = walk(np.append(jump, len(jump)), count)
            last = int(jump[starts[-1]]) + self.at if starts[-1] < len(jump) else size + 1
            if last <= end:
                break
            if end == size:
                raise ended("Rice code")
            room *= 2
        starts += self.at
        self.at = last
        one = ones[starts]
        value = one - starts
        for j in range(k):
            value = value << 1 | self.bits[one + 1 + j]
        return value >> 1 ^ -(value & 1)

    def coded(self) -> int:
        """The UTF-8-like coded number of up to 36 bits."""
        first = self.uint(8)
        if first < 0x80:
            return first
        more = 8 - (first ^ 0xFF).bit_length() - 1
        if not 1 <= more <= 6:
            raise ended("coded number")
        value = first & (0x3F >> more)
        for _ in range(more):
            value = value << 6 | self.uint(8) & 0x3F
        return value

    def align(self) -> None:
        self.at += -self.at % 8


def walk(jump: np.ndarray, count: int) -> np.ndarray:
    """The first count places on the way from 0, where each leads to jump[place]; jump never leads out of itself.

    Few places are walked to one by one: those between come from jumps of half as many steps, for all at once.
    """
    level, far = [jump], 1
    while len(level) < 8 and 4 * far * far < count:
        level.append(level[-1].take(level[-1], mode="clip"))
        far *= 2
    places, at = [0], 0
    for _ in range((count - 1) // far):
        at = int(level[-1][at])
        places.append(at)
    found = np.array(places, np.int64)
    for step in level[-2::-1]:
        found = np.stack([found, step[found]], axis=1).ravel()
    return found[:count]


class BitSink:
    """Collects pieces of bits."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def uint(self, value: int, n: int) -> None:
        self.parts.append(np.array([value >> (n - 1 - i) & 1 for i in range(n)], np.uint8))

    def array(self, values: np.ndarray, n: int) -> None:
        self.parts.append(((values[:, None] >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8).ravel())

    def rice(self, zigzag: np.ndarray, k: int) -> None:
        """Each as (z >> k) zeros, a 1, and its low k bits."""
        high = zigzag >> k
        ends = np.cumsum(high + 1 + k)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        one = ends - 1 - k
        out[one] = 1
        for j in range(k):
            out[one + 1 + j] = zigzag >> (k - 1 - j) & 1
        self.parts.append(out)

    def coded(self, value: int) -> None:
        if value < 0x80:
            self.uint(value, 8)
            return
        more = next(m for m in range(1, 7) if value < 1 << (6 * m + 6 - m))
        self.uint((0xFF << (7 - more) & 0xFF) | value >> (6 * more), 8)
        for i in range(more - 1, -1, -1):
            self.uint(0x80 | value >> (6 * i) & 0x3F, 8)

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts)).tobytes() if self.parts else b""


@cache
def crc_table(width: int, poly: int) -> tuple[int, ...]:
    """CRC of each byte, most significant bit first, from zero."""
    mask, top = (1 << width) - 1, 1 << (width - 1)
    table = []
    for b in range(256):
        crc = b << (width - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc & top else crc << 1) & mask
        table.append(crc)
    return tuple(table)


class Crc:
    """A CRC from zero is linear, so it is the xor of what each byte gives at its distance from the end."""

    STEP = 1024
    places = np.arange(STEP - 1, -1, -1) * 256

    def __init__(self, width: int, poly: int):
        self.table = np.array(crc_table(width, poly), np.uint64)
        self.width, self.mask, self.small = width, np.uint64((1 << width) - 1), np.dtype(f"u{width // 8}")
        self.at = np.zeros((0, 256), self.small)

    def _reach(self, n: int) -> None:
        if n > len(self.at):
            rows = list(self.at[-1:].astype(np.uint64)) or [self.table]
            grown = [] if len(self.at) else [self.table]
            while len(self.at) + len(grown) < n:
                last = grown[-1] if grown else rows[0]
                grown.append((last << np.uint64(8) & self.mask) ^ self.table[(last >> np.uint64(self.width - 8)).astype(np.intp)])
            self.at = np.concatenate([self.at, np.array(grown, np.uint64).reshape(-1, 256).astype(self.small)])

    def __call__(self, data: bytes, before: int = 0) -> int:
        """Of the data, after data whose CRC is before."""
        raw = np.frombuffer(data, np.uint8)
        crc = np.uint64(before)
        self._reach(min(len(raw), self.STEP))
        for i in range(0, len(raw), self.STEP):
            part = raw[i : i + self.STEP].copy()
            own = int(crc)
            head = np.zeros(len(part), np.uint8)
            size = self.width // 8
            lead = own.to_bytes(size, "big")[: len(part)]
            head[: len(lead)] = np.frombuffer(lead, np.uint8)
            part ^= head
            crc = np.uint64(np.bitwise_xor.reduce(self.at.ravel()[self.places[-len(part) :] + part]))
            if len(part) < size:
                crc = np.uint64((int(crc) ^ own << 8 * len(part)) & int(self.mask))
        return int(crc)


crc8 = Crc(8, 0x07)
crc16 = Crc(16, 0x8005)
crc32_ogg = Crc(32, 0x04C11DB7)
