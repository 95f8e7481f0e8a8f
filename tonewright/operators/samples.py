"""Clips (one row, pcm an array) to sample rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(clips: DataFrame, pcm: str = "pcm", channels: Column | int = 1) -> DataFrame:
    """clip, frame, ch, s of each sample of interleaved pcm."""
    n = channels if isinstance(channels, Column) else F.lit(channels)
    rows = clips.select("clip", n.alias("_n"), F.posexplode(pcm).alias("idx", "s"))
    return rows.select("clip", F.floor(F.col("idx") / F.col("_n")).cast("int").alias("frame"), (F.col("idx") % F.col("_n")).cast("int").alias("ch"), "s")


def collected(samples: DataFrame, value: str = "s", keys: tuple[str, ...] = ("clip",)) -> DataFrame:
    """Interleaved pcm of each clip, by frame and channel."""
    pairs = F.sort_array(F.collect_list(F.struct("frame", "ch", value)))
    return samples.groupBy(*keys).agg(F.transform(pairs, lambda x: x[value]).alias("pcm"))
