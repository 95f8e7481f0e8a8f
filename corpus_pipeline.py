"""The training corpus from documents: five stages, each written as Parquet and read again by the next.

Rows are told apart by doc_id and text, so repeated ids, and rows without one, are decided each for itself. Null and empty texts fail the
quality rules. Texts are read whole at any length. Of copies the one with the least doc_id stays, of equal rows one; rows
without a doc_id are no one's copies and stay. All but the last stage
return the columns of documents, other columns included, whatever their names. An empty table goes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonewright.llm import decontaminate, line_dedup, mixing, quality, simhash
from tonewright.llm.storage import delete, fresh, passing
from tonewright.llm.text import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.corpus_without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_repeats),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
]

#: SQL can't express the robust estimates or the fingerprints; a test holds run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage settles, and what it read, is deleted when its result is written; the result by storage.forget."""
    docs, read = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh(spark, f"pipeline-{k}")
        with passing(spark, f"stage-{k}"):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if read:
            delete(spark, read)
        read = path
    return docs
