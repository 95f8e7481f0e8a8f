"""Windowed-sinc resampling.

`resample` works on clips: each is turned by whole arrays in Arrow batches, its weights taken from a
table of phases that repeats with period dst / gcd(src, dst). No shuffle. `resample_pieces` is for clips that stand in many
rows: blocks of frames, each with the h frames on either side that its taps reach, meet in one shuffle of little more than the input.
`resample_rows` is the
relational form over sample rows: each source sample meets the output frames that it touches, its
weight is an expression, and sums are grouped by output frame (with map-side combine).

Weights: sinc(x) by a Blackman-Harris window, x = (i - frac) * min(1, dst/src), i from -h to h, h =
ceil(half width / min(1, dst/src)); the window's half width is h itself. Taps outside the clip are
left out and the rest normalised; a sum of weights within 1e-10 of 0 gives 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.sources.errors import AudioError

HALF_WIDTH = {"Draft": 2, "Good": 8, "Best": 32}
# Fixed values of the Blackman-Harris window.
WINDOW = (0.35875, 0.48829, 0.14128, 0.01168)
PHASES = 4096


def check(src: int, dst: int, channels: int) -> None:
    if src <= 0 or dst <= 0:
        raise AudioError("InvalidSampleRate", str(min(src, dst)))
    if channels <= 0:
        raise AudioError("InvalidChannels", str(channels))


def reach(src: int, dst: int, quality: str) -> tuple[float, int]:
    """Scale of the kernel and number of taps to a side."""
    scale = min(1.0, dst / src)
    return scale, math.ceil(HALF_WIDTH[quality] / scale)


def taps_of(src: Column, dst: Column, quality: Column) -> Column:
    """Number of taps to a side, by row; null for an unknown quality."""
    half = F.create_map(*[F.lit(x) for pair in HALF_WIDTH.items() for x in pair])
    return F.ceil(F.try_element_at(half, quality) / F.least(F.lit(1.0), dst / src)).cast("int")


def windowed_sinc(x: Column, half: int | float) -> Column:
    turn = math.tau * ((x / F.lit(float(half)) + 1) * 0.5)
    window = WINDOW[0] - WINDOW[1] * F.cos(turn) + WINDOW[2] * F.cos(2 * turn) - WINDOW[3] * F.cos(3 * turn)
    px = math.pi * x
    return F.when(F.abs(x) < 1e-10, 1.0).when(F.abs(x) > half, 0.0).otherwise(F.sin(px) / px * window)


def taps(frac: np.ndarray, scale: float, h: int) -> np.ndarray:
    """Weights (frames, 2h + 1)."""
    x = (np.arange(-h, h + 1)[None, :] - frac[:, None]) * scale
    turn = math.tau * (x / h + 1) / 2
    window = WINDOW[0] - WINDOW[1] * np.cos(turn) + WINDOW[2] * np.cos(2 * turn) - WINDOW[3] * np.cos(3 * turn)
    return np.where(np.abs(x) < 1e-10, 1.0, np.where(np.abs(x) > h, 0.0, np.sinc(x) * window))


@lru_cache(maxsize=16)
def phase_table(src: int, dst: int, quality: str) -> np.ndarray | None:
    """Weights by phase; None if there are more than PHASES phases, which are then computed as needed."""
    period = dst // math.gcd(src, dst)
    scale, h = reach(src, dst, quality)
    return taps((np.arange(period) * src % dst) / dst, scale, h) if period <= PHASES else None


def mono(x: np.ndarray, src: int, dst: int, quality: str, chunk: int = 8192) -> np.ndarray:
    """One channel."""
    return span(x, 0, 0, -(-len(x) * dst // src), src, dst, quality, chunk)


def span(x: np.ndarray, base: int, low: int, high: int, src: int, dst: int, quality: str, chunk: int = 8192) -> np.ndarray:
    """Output frames [low, high) from the frames of one channel from base on, in chunks so memory stays bounded.

    Taps before frame 0 or past the end of x are left out, so x must hold all others: h frames on either side, or up to an end of the clip.
    """
    n, count = base + len(x), high - low
    scale, h = reach(src, dst, quality)
    table = phase_table(src, dst, quality)
    padded = np.pad(np.asarray(x, np.float64), h)
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * h + 1) if len(x) else np.zeros((0, 2 * h + 1))
    out = np.zeros(count, np.float32)
    for at in range(0, count, chunk):
        f = np.arange(low + at, low + min(count, at + chunk), dtype=np.int64)
        place = f * src // dst
        w = table[f % len(table)] if table is not None else taps((f * src % dst) / dst, scale, h)
        total = np.einsum("ij,ij->i", windows[place - base], w)
        if place[0] < h or place[-1] + h >= n:
            near = place[:, None] + np.arange(-h, h + 1)
            w = np.where((near >= 0) & (near < n), w, 0.0)
        whole = w.sum(axis=1)
        ok = np.abs(whole) > 1e-10
        out[at : at + len(f)] = np.where(ok, total / np.where(ok, whole, 1.0), 0.0)
    return out


def interleaved(pcm: np.ndarray, channels: int, src: int, dst: int, quality: str) -> np.ndarray:
    """All channels of one clip; a partial last frame counts with zeros for what is missing."""
    check(src, dst, channels)
    if src == dst:
        return pcm
    frames = -(-len(pcm) // channels)
    planes = np.pad(pcm, (0, frames * channels - len(pcm))).reshape(frames, channels)
    return np.stack([mono(planes[:, c], src, dst, quality) for c in range(channels)], axis=1).ravel()


def resample(clips: DataFrame, src: int, dst: int, quality: str = "Good", channels: int = 1, keep: tuple[str, ...] = ("clip",)) -> DataFrame:
    """keep and pcm at the new rate; equal rates return the clips as they are."""
    check(src, dst, channels)
    rows = clips.select(*keep, F.col("pcm").cast("array<float>").alias("pcm"))
    if src == dst:
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tonewright.sources.registry import lists

        for batch in batches:
            out = [None if p.values is None else interleaved(p.values.to_numpy(zero_copy_only=False), channels, src, dst, quality) for p in batch.column("pcm")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists(out, pa.float32())], [*keep, "pcm"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", pcm array<float>")


def resample_pieces(pieces: DataFrame, src: int, dst: int, quality: str = "Good", channels: int = 1, keep: tuple[str, ...] = ("clip",), size: int = 65536) -> DataFrame:
    """keep, first (index of the first frame at the new rate) and pcm of pieces (keep, first, pcm) of clips, to the bit what `resample` gives for whole clips.

    Pieces of a clip follow one another without overlap; all but the last hold whole frames. Blocks of size frames are made by tasks of
    their own, so no clip is one row; a gap inside a clip is an AudioError. Null and empty pieces give nothing. Equal rates return the pieces.
    """
    check(src, dst, channels)
    rows = pieces.select(*keep, F.col("first").cast("long").alias("first"), F.coalesce(F.col("pcm").cast("array<float>"), F.array().cast("array<float>")).alias("pcm"))
    if src == dst:
        return rows
    h = reach(src, dst, quality)[1]
    first, frames = F.col("first"), F.ceil(F.size("pcm") / channels)
    near = F.sequence(F.greatest(F.floor((first - h) / size), F.lit(0)), F.floor((first + frames - 1 + h) / size))
    each = rows.filter(F.size("pcm") > 0).withColumn("block", F.explode(near))
    low = F.greatest(F.col("block") * size - h - first, F.lit(0))
    high = F.least((F.col("block") + 1) * size + h - first, frames)
    cut = each.select(*keep, "block", (first + low).alias("first"), F.slice("pcm", (low * channels + 1).cast("int"), ((high - low) * channels).cast("int")).alias("pcm"))
    met = cut.groupBy(*keep, "block").agg(F.sort_array(F.collect_list(F.struct("first", "pcm"))).alias("all"))
    parts = F.transform("all", lambda p: F.struct(p["first"].alias("first"), F.ceil(F.size(p["pcm"]) / channels).alias("n")))
    ready = met.select(*keep, "block", parts.alias("parts"), F.flatten("all.pcm").alias("pcm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tonewright.sources.registry import lists

        for batch in batches:
            rows, firsts, out = [], [], []
            for i, (block, parts, pcm) in enumerate(zip(batch.column("block").to_pylist(), batch.column("parts").to_pylist(), batch.column("pcm"), strict=True)):
                base, end = parts[0]["first"], parts[0]["first"]
                for p in parts:
                    if p["first"] != end:
                        raise AudioError("DecodeError", f"frames {end} to {p['first']} of a clip are missing or double")
                    end += p["n"]
                if end <= block * size:
                    continue  # past the end of the clip
                if base != max(0, block * size - h):
                    raise AudioError("DecodeError", f"frames before {base} of a clip are missing")
                low, high = -(-block * size * dst // src), -(-min(end, (block + 1) * size) * dst // src)
                x = pcm.values.to_numpy(zero_copy_only=False)
                planes = np.pad(x, (0, (end - base) * channels - len(x))).reshape(-1, channels)
                out.append(np.stack([span(planes[:, c], base, low, high, src, dst, quality) for c in range(channels)], axis=1).ravel())
                firsts.append(low)
                rows.append(i)
            own = [batch.column(c).take(pa.array(rows, pa.int32())) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(firsts, pa.int64()), lists(out, pa.float32())], [*keep, "first", "pcm"])

    types = dict(ready.dtypes)
    return ready.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", first long, pcm array<float>")


def touched(samples: DataFrame, src: int, dst: int, quality: str) -> DataFrame:
    """clip, ch, out, s, w: each sample with the output frames that it touches and its weight there."""
    scale, h = reach(src, dst, quality)
    frame = F.col("frame").cast("long")
    low = F.greatest(F.ceil((frame - h) * dst / src), F.lit(0))
    # The centre floor(out * src / dst) is within h of the frame.
    high = F.ceil((frame + h + 1) * F.lit(dst).cast("double") / src) - 1
    ends = samples.groupBy("clip", "ch").agg((F.max("frame") + 1).alias("n"))
    spread = samples.join(ends, ["clip", "ch"]).withColumn("last", F.ceil(F.col("n") * F.lit(dst).cast("double") / src) - 1)
    spread = spread.select("clip", "ch", "frame", "s", F.explode(F.sequence(low.cast("long"), F.least(high, F.col("last")).cast("long"))).alias("out")).filter("out >= 0")
    centre = F.floor(F.col("out") * src / dst)
    frac = F.pmod(F.col("out") * src, F.lit(dst)) / F.lit(float(dst))
    i = frame - centre
    return spread.filter(F.abs(i) <= h).select("clip", "ch", "out", "s", windowed_sinc((i - frac) * scale, h).alias("w"))


def weighted_sum(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total (sum of s by w) and weight."""
    return rows.groupBy(*keys).agg(F.sum(F.col("s").cast("double") * F.col("w")).alias("total"), F.sum("w").alias("weight"))


def resample_rows(samples: DataFrame, src: int, dst: int, quality: str = "Good") -> DataFrame:
    """clip, ch, frame, s (double) from rows clip, ch, frame, s."""
    sums = weighted_sum(touched(samples, src, dst, quality), ["clip", "ch", "out"])
    value = F.when(F.abs("weight") > 1e-10, F.col("total") / F.col("weight")).otherwise(0.0)
    return sums.select("clip", "ch", F.col("out").alias("frame"), value.alias("s"))
