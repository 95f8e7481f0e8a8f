"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where none is set and all runs on one machine, as in tests, a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = spark.sparkContext.applicationId
        where = _own.get(name) or f"file://{tempfile.mkdtemp(prefix='tonewright-')}"
        _own[name] = where
    return where.rstrip("/")


def _of_application(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tonewright-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path for a new table or folder; `forget` deletes it, or the end of the `passing` step that it belongs to."""
    return f"{_folder.get() or _of_application(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str, *told: Column) -> DataFrame:
    """df written to the shared folder and read again: later steps survive lost executors and don't repeat it. told: further sums, taken as it is written."""
    spark, path, seen = df.sparkSession, fresh(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(f"told{k}") for k, c in enumerate(told)]).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_rows = seen.get["n"]
    out.settled_sums = tuple(seen.get.values())
    return out


def small(df: DataFrame, most: int = 500_000, rows: int | None = None) -> DataFrame:
    """Marks a settled table of narrow rows for broadcast if it has at most so many; else Spark joins by shuffle. rows is known to be no less."""
    n = df.__dict__.get("settled_rows") if rows is None else rows
    return F.broadcast(df) if (df.count() if n is None else n) <= most else df


def delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(spark: SparkSession, name: str) -> Iterator[None]:
    """Deletes what is settled inside at the end: for a step whose result is written before that."""
    where = fresh(spark, name)
    mark = _folder.set(where)
    try:
        yield
    finally:
        _folder.reset(mark)
        delete(spark, where)


def forget(spark: SparkSession) -> None:
    """Deletes all that the application settled, for when its results are written."""
    delete(spark, _of_application(spark))
