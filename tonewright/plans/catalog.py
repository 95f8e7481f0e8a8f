"""Registered queries: a name, a function (spark, sf_dir) -> DataFrame and, where SQL can say it, the SQL.

The tables hold no audio; each query says which of them stands in for a signal. `embeddings` are
clips of 64 mono samples (or 32 stereo frames), integers of `lineitem` and `orders` are samples or
header bytes, texts are payloads and tags, `conversations` are packets in order.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_own: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share: under spark.checkpoint.dir; without it, if all runs on one machine, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own.get(spark.sparkContext.applicationId) or f"file://{tempfile.mkdtemp(prefix='tonewright-')}"
        _own[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def clips(spark: SparkSession, sf_dir: str, gain: float = 1.0) -> DataFrame:
    """clip, pcm."""
    pcm = F.col("embedding") if gain == 1.0 else F.transform("embedding", lambda s: s * F.lit(gain).cast("float"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip"), pcm.alias("pcm"))


def samples(spark: SparkSession, sf_dir: str, gain: float = 1.0, pcm: str = "pcm") -> DataFrame:
    """clip, i, s."""
    return clips(spark, sf_dir, gain).select("clip", F.posexplode(pcm).alias("i", "s"))


def listed(df: DataFrame, column: str = "pcm", name: str = "y", kind: str = "double") -> DataFrame:
    """Arrays to rows (clip, i, name)."""
    return df.select("clip", F.posexplode(column).alias("i", name)).withColumn(name, F.col(name).cast(kind))


#: CTEs of the same readings for SQL.
SAMPLES = "samples AS (SELECT vec_id AS clip, unnest(range(len(embedding)))::INT AS i, unnest(embedding) AS s FROM embeddings)"
LOUD = "samples AS (SELECT vec_id AS clip, unnest(range(len(embedding)))::INT AS i, unnest(embedding) * 4::FLOAT AS s FROM embeddings)"
UNIT = "greatest(-1::FLOAT, least(1::FLOAT, s))"
INTS = "ints AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey * 40503 + l_linenumber * 977) % 65536 - 32768 AS a, (l_orderkey * 2654435761 + l_linenumber) % 4294967296 - 2147483648 AS b FROM lineitem)"


def ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, n, a (16 bits) and b (32 bits)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("n"),
        (F.expr("(l_partkey * 40503 + l_linenumber * 977) % 65536 - 32768")).alias("a"),
        (F.expr("(l_orderkey * 2654435761 + l_linenumber) % 4294967296 - 2147483648")).alias("b"),
    )


def byte_at(blob: str, i: str) -> str:
    """SQL for an unsigned byte of a blob, from 0."""
    return f"('0x' || substr(hex({blob}), 2 * ({i})::INT + 1, 2))::BIGINT"
