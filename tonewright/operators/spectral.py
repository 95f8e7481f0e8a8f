"""Transforms and the lossy encoders' analysis stages.

Bins are rows (clip, k, x). Bands come from a literal array indexed by bin, so no range join is
needed. Transforms of long frames run over whole arrays in Arrow batches; `dft_rows` and
`mdct_rows` are the direct sums as joins to a basis, for short frames.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.functions.numeric import lookup, round_away, trunc
from tonewright.sources import aac, opus, transform

MOST_JOINED = 256


def sine_window(i: Column, n: int) -> Column:
    return F.sin(math.pi / n * (i + 0.5))


def windowed(samples: DataFrame, n: int) -> DataFrame:
    """clip, i, s times the window."""
    return samples.select("clip", "i", (F.col("s").cast("double") * sine_window(F.col("i"), n)).alias("s"))


def _basis(spark: SparkSession, n: int, bins: int) -> DataFrame:
    if n > MOST_JOINED:
        raise ValueError(f"the direct sum is for frames of up to {MOST_JOINED}; use the transform of arrays")
    return spark.range(n * bins).select((F.col("id") % n).cast("int").alias("i"), F.floor(F.col("id") / n).cast("int").alias("k"))


def dft_rows(samples: DataFrame, n: int) -> DataFrame:
    """clip, k, re, im by direct sums over rows (clip, i, s)."""
    turn = 2 * math.pi / n * F.pmod(F.col("i") * F.col("k"), F.lit(n))
    basis = _basis(samples.sparkSession, n, n).select("i", "k", F.cos(turn).alias("c"), (-F.sin(turn)).alias("d"))
    x = F.col("s").cast("double")
    return samples.join(F.broadcast(basis), "i").groupBy("clip", "k").agg(F.sum(x * F.col("c")).alias("re"), F.sum(x * F.col("d")).alias("im"))


def mdct_rows(samples: DataFrame, n: int, standard: bool = False) -> DataFrame:
    """clip, k, x by direct sums; pi/n as the analysis stages use it, or the usual 2 pi/n."""
    scale = (2 if standard else 1) * math.pi / n
    c = F.cos(scale * (F.col("i") + 0.5 + n / 4) * (F.col("k") + 0.5))
    basis = _basis(samples.sparkSession, n, n // 2).select("i", "k", c.alias("c"))
    return samples.join(F.broadcast(basis), "i").groupBy("clip", "k").agg(F.sum(F.col("s").cast("double") * F.col("c")).alias("x"))


def _arrays(frames: DataFrame, column: str, f: Callable[[np.ndarray], list[np.ndarray]], names: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    rows = frames.select(*keep, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tonewright.sources.registry import lists

        for batch in batches:
            parts = [f(p.values.to_numpy(zero_copy_only=False)) if p.values is not None else [None] * len(names) for p in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[lists([p[k] for p in parts], pa.float64()) for k in range(len(names))]], [*keep, *names])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in keep], *[f"{n} array<double>" for n in names]]))


def fft(frames: DataFrame, column: str = "pcm", keep: tuple[str, ...] = ("clip",)) -> DataFrame:
    """keep, re, im of each frame (array)."""

    def one(x: np.ndarray) -> list[np.ndarray]:
        y = transform.fft(x)
        return [y.real, y.imag]

    return _arrays(frames, column, one, ("re", "im"), keep)


def mdct(frames: DataFrame, column: str = "pcm", standard: bool = False, keep: tuple[str, ...] = ("clip",)) -> DataFrame:
    f = transform.mdct if standard else transform.mdct_ref
    return _arrays(frames, column, lambda x: [f(x)], ("bins",), keep)


def band_of(k: Column, edges: list[int]) -> Column:
    """Band of a bin."""
    return lookup(k, [b for b in range(len(edges) - 1) for _ in range(edges[b], edges[b + 1])])


def width_of(band: Column, edges: list[int]) -> Column:
    return lookup(band, [b - a for a, b in zip(edges, edges[1:])])


def downmix(samples: DataFrame, channels: int) -> DataFrame:
    """clip, frame, s: mean of the channels of rows (clip, frame, ch, s)."""
    return samples.groupBy("clip", "frame").agg((F.sum(F.col("s").cast("double")) / channels).alias("s"))


def frame_split(samples: DataFrame, size: int = opus.FRAME, pre_skip: int = opus.PRE_SKIP) -> DataFrame:
    """clip, block, n, granule: frames of a size and the running count that their pages carry."""
    blocks = samples.groupBy("clip", F.floor(F.col("frame") / size).alias("block")).agg(F.countDistinct("frame").alias("n"))
    return blocks.withColumn("granule", pre_skip + F.sum("n").over(Window.partitionBy("clip").orderBy("block")))


def band_energy(bins: DataFrame, edges: list[int] = opus.BAND_EDGES) -> DataFrame:
    """clip, band, energy: log2 of the mean square, at least 1e-10."""
    band = band_of(F.col("k"), edges)
    sums = bins.groupBy("clip", band.alias("band")).agg(F.sum(F.col("x") * F.col("x")).alias("p"))
    return sums.select("clip", "band", F.log2(F.greatest(F.col("p") / width_of(F.col("band"), edges), F.lit(1e-10))).alias("energy"))


def energy_quant(energy: Column) -> Column:
    return round_away(energy * 2)


def energy_code(bands: DataFrame) -> DataFrame:
    """clip, band, q, symbol: differences to the band below, from 0 to 127."""
    before = F.coalesce(F.lag("q").over(Window.partitionBy("clip").orderBy("band")), F.lit(0))
    q = bands.select("clip", "band", energy_quant(F.col("energy")).alias("q"))
    return q.withColumn("symbol", F.greatest(F.lit(-64), F.least(F.lit(63), F.col("q") - before)) + 64)


def normalised(bins: DataFrame, edges: list[int] = opus.BAND_EDGES) -> DataFrame:
    """clip, k, x over the norm of its band."""
    w = Window.partitionBy("clip", band_of(F.col("k"), edges))
    norm = F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x")).over(w)), F.lit(1e-10))
    return bins.select("clip", "k", (F.col("x") / norm).alias("x"))


def aac_band_quant(bins: DataFrame, edges: list[int] = aac.BANDS) -> DataFrame:
    """clip, k, band, scale, q."""
    band = band_of(F.col("k"), edges)
    w = Window.partitionBy("clip", band)
    rms = F.sqrt(F.sum(F.col("x") * F.col("x")).over(w) / width_of(band, edges))
    scale = F.when(rms > 1e-10, F.greatest(F.lit(0), F.least(F.lit(200), trunc(100 + 4 * (F.log2(rms) - math.log2(10 / 128)))))).otherwise(0)
    found = bins.select("clip", "k", band.alias("band"), scale.alias("scale"), "x")
    q = F.least(F.floor(F.pow(F.abs("x"), F.lit(0.75)) / F.pow(F.lit(2.0), 0.25 * (F.col("scale") - 100)) + 0.5), F.lit(8191))
    return found.select("clip", "k", "band", "scale", F.when(F.col("x") >= 0, q).otherwise(-q).cast("int").alias("q"))


def aac_bands(quantised: DataFrame) -> DataFrame:
    """clip, band, scale, used."""
    return quantised.groupBy("clip", "band").agg(F.max("scale").alias("scale"), (F.max(F.abs("q")) > 0).alias("used"))


def aac_sections(bands: DataFrame) -> DataFrame:
    """clip, section, used, first, run: islands of used and unused bands."""
    w = Window.partitionBy("clip").orderBy("band")
    edge = F.when(F.lag("used").over(w) == F.col("used"), 0).otherwise(1)
    marked = bands.withColumn("_edge", edge).withColumn("section", F.sum("_edge").over(w))
    return marked.groupBy("clip", "section").agg(F.first("used").alias("used"), F.min("band").alias("first"), F.count("*").alias("run"))


def aac_scale_deltas(bands: DataFrame) -> DataFrame:
    """clip, band, code: difference to the used band before (the first to the scale of band 0), from 0 to 120."""
    first = F.first("scale").over(Window.partitionBy("clip").orderBy("band"))
    w = Window.partitionBy("clip").orderBy("band")
    used = bands.withColumn("_first", first).filter("used")
    delta = F.col("scale") - F.coalesce(F.lag("scale").over(w), F.col("_first"))
    return used.select("clip", "band", F.greatest(F.lit(0), F.least(F.lit(120), delta + 60)).alias("code"))
