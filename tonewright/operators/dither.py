"""Dither: triangular noise of one step, plain or with first-order error feedback.

The noise depends on a sample's index alone (the generator restarts with each clip and runs across
interleaved channels). A step of the generator is a linear map of 32 bits, so its state at any index is a product of
squares of that map: lanes start at indices of their own and step together, and a part of a clip has its noise without the
parts before it. Plain dither adds noise by the piece; feedback is a recurrence, and the clips of a batch take its steps together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions.numeric import f32

SEED = 0x12345678
MASK = 0xFFFFFFFF
MOST_VALUES = 1 << 24  # that a task works on at once
PIECE = 1 << 20  # samples of noise made at once, and kept


def xorshift32(x: Column) -> Column:
    """One step, on BIGINT."""
    low = F.lit(MASK).cast("long")
    x = x.bitwiseXOR(F.shiftleft(x, 13)).bitwiseAND(low)
    x = x.bitwiseXOR(F.shiftright(x, 17))
    return x.bitwiseXOR(F.shiftleft(x, 5)).bitwiseAND(low)


def step_of(bits: int) -> float:
    return 1.0 / (1 << (min(32, max(1, bits)) - 1))


def uniform(state: Column) -> Column:
    """From -1 to 1, in f32."""
    return state.cast("float") / f32(4294967295) * f32(2) - f32(1)


def _step(x: np.ndarray) -> np.ndarray:
    x = x ^ x << np.uint32(13)
    x ^= x >> np.uint32(17)
    return x ^ x << np.uint32(5)


def _apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A map of 32 bits, given as the images of its bits, on each of x."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= columns[bit] * (x >> np.uint32(bit) & np.uint32(1))
    return out


@lru_cache(1)
def _jumps() -> list[np.ndarray]:
    """Maps of 1, 2, 4, ... steps."""
    out = [_step(np.uint32(1) << np.arange(32, dtype=np.uint32))]
    for _ in range(63):
        out.append(_apply(out[-1], out[-1]))
    return out


def jumped(x: np.ndarray, steps: np.ndarray | int) -> np.ndarray:
    """Each state after as many steps."""
    x, left = np.array(x, np.uint32), np.broadcast_to(np.asarray(steps, np.int64), np.shape(x))
    for k in range(int(left.max(initial=0)).bit_length()):
        x = np.where(left >> k & 1, _apply(_jumps()[k], x), x)
    return x


def states_at(index: np.ndarray) -> np.ndarray:
    """The generator's state after index steps from SEED."""
    return jumped(np.full(len(index), SEED, np.uint32), index)


def noise_range(start: int, n: int) -> np.ndarray:
    """(r1 + r2) / 2 of the samples start to start + n, f32: two draws a sample, in lanes that step together."""
    each = 2 * max(1, int(np.sqrt(n / 2)))  # draws a lane
    lanes = -(-2 * n // each)
    x = jumped(np.full(lanes, SEED, np.uint32), 2 * start + each * np.arange(lanes))
    out = np.empty((each, lanes), np.float32)
    for k in range(each):
        x = _step(x)
        out[k] = x
    out /= np.float32(4294967295)
    out *= np.float32(2)
    out -= np.float32(1)
    r = out[::2] + out[1::2]
    r *= np.float32(0.5)
    return np.ascontiguousarray(r.T).ravel()[:n]


def noise_table(n: int) -> np.ndarray:
    return noise_range(0, n)


_noise = np.zeros(0, np.float32)


def noise_upto(n: int) -> np.ndarray:
    """The table's first n; a worker keeps what it made, up to PIECE, and at least doubles it."""
    global _noise
    if n > PIECE:
        return noise_table(n)
    if n > len(_noise):
        _noise = noise_table(min(PIECE, max(n, 2 * len(_noise), 4096)))
    return _noise[:n]


def with_noise(x: np.ndarray, step: float, start: int = 0) -> np.ndarray:
    """Samples from index start on with their noise."""
    out = np.array(x, np.float32)
    for at in range(0, len(out), PIECE):
        part = out[at : at + PIECE]
        first = start + at
        part += (noise_upto(first + len(part))[first:] if first + len(part) <= PIECE else noise_range(first, len(part))) * np.float32(step)
    return out


def shaped(clips: list[np.ndarray], step: float) -> list[np.ndarray]:
    """Clips with error feedback, sample by sample, clips of like length at once."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(clips)
    rest = sorted((i for i in range(len(clips)) if len(clips[i])), key=lambda i: -len(clips[i]))
    while rest:
        fit = max(1, MOST_VALUES // len(clips[rest[0]]))
        for i, x in zip(rest[:fit], _in_step([clips[i] for i in rest[:fit]], np.float32(step)), strict=True):
            out[i] = x
        rest = rest[fit:]
    return out


def _in_step(clips: list[np.ndarray], one: np.float32) -> list[np.ndarray]:
    """Of clips from the longest to the shortest."""
    sizes = np.array([len(x) for x in clips])
    n = int(sizes[0])
    x, noise, error = np.zeros((n, len(clips)), np.float32), noise_upto(n) * one, np.zeros(len(clips), np.float32)
    for k, c in enumerate(clips):
        x[: len(c), k] = c
    for i, own in enumerate(np.searchsorted(-sizes, -np.arange(n))):  # so many clips have a sample i
        want = x[i, :own] - error[:own]
        r = (want + noise[i]) / one
        x[i, :own] = np.copysign(np.floor(np.abs(r) + np.float32(0.5)), r) * one
        error[:own] = x[i, :own] - want
    return [x[:s, k] for k, s in enumerate(sizes)]


def dither(clips: DataFrame, bits: int, feedback: bool = False, keep: tuple[str, ...] = ("clip",), at: Column | None = None) -> DataFrame:
    """keep and pcm with noise of one step at the depth; with feedback also rounded to it.

    at: index of a row's first sample (over all channels) within its clip, for plain dither of clips in parts.
    """
    if feedback and at is not None:
        raise ValueError("feedback needs whole clips")
    step = step_of(bits)
    given = F.lit(0) if at is None else at
    rows = clips.select(*keep, given.cast("long").alias("first_sample"), F.col("pcm").cast("array<float>").alias("pcm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tonewright.sources.registry import lists

        for batch in batches:
            given = [None if p.values is None else p.values.to_numpy(zero_copy_only=False) for p in batch.column("pcm")]
            if feedback:
                done = iter(shaped([x for x in given if x is not None], step))
                out = [None if x is None else next(done) for x in given]
            else:
                out = [None if x is None else with_noise(x, step, k or 0) for x, k in zip(given, batch.column("first_sample").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists(out, pa.float32())], [*keep, "pcm"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", pcm array<float>")


def tpdf_dither(clips: DataFrame, bits: int, keep: tuple[str, ...] = ("clip",), at: Column | None = None) -> DataFrame:
    return dither(clips, bits, keep=keep, at=at)


def noise_shaped_dither(clips: DataFrame, bits: int, keep: tuple[str, ...] = ("clip",)) -> DataFrame:
    return dither(clips, bits, feedback=True, keep=keep)


def state_after(steps: Column) -> Column:
    """The generator's state after as many steps, by jumps."""
    return F.pandas_udf(lambda n: pd.Series(states_at(n.fillna(0).to_numpy(np.int64)).astype(np.int64)).where(n.notna(), None), "long")(steps.cast("long"))


def states(n: int) -> Column:
    """Array of the generator's first n states, as a fold (JVM-side)."""
    start = F.struct(F.lit(SEED).cast("long").alias("x"), F.array().cast("array<bigint>").alias("all"))

    def step(acc: Column, _: Column) -> Column:
        x = xorshift32(acc["x"])
        return F.struct(x.alias("x"), F.concat(acc["all"], F.array(x)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda acc: acc["all"])
