"""Tags from rows of frames or pairs: the last of a field wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions.headers import id3_comment, id3_text
from tonewright.sources import tags

FIELDS = list(tags.FIELDS)


def pair(comment: Column) -> tuple[Column, Column]:
    """FIELD in upper case and value of "field=value", cut at the first =; value null without one or if empty."""
    at = F.instr(comment, "=")
    return F.upper(F.when(at > 0, F.substring(comment, F.lit(1), at - 1))), F.nullif(F.when(at > 0, F.substring(comment, at + 1, F.length(comment))), F.lit(""))


def pivoted(rows: DataFrame, names: dict[str, str], keep: tuple[str, ...], field: str, value: str, order: str) -> DataFrame:
    """keep and a column for each field: the value with the largest order among its names."""
    out = []
    for f in FIELDS:
        own = F.col(field).isin(*[k for k, v in names.items() if v == f]) & F.col(value).isNotNull()
        out.append(F.max_by(F.when(own, F.col(value)), F.when(own, F.col(order))).alias(f))
    return rows.groupBy(*keep).agg(*out)


def from_vorbis(pairs: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Of rows (field, value, pair_no)."""
    return pivoted(pairs, tags.VORBIS, keep, "field", "value", "pair_no")


def from_id3(frames: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Of rows (id, body, frame_no) of either version; comments lose their language and description."""
    names = tags.ID3V22 | tags.ID3V23
    body = F.col("body")
    said = F.when(F.col("id").isin("COM", "COMM"), id3_comment(body)).otherwise(id3_text(body))
    return pivoted(frames.withColumn("value", said), names, keep, "id", "value", "frame_no")
