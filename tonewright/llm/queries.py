"""Queries opN_... over the test tables, and SQL for those that it can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm import alignment, chat, decontaminate, edit_print, lexical, licenses, line_dedup, mixing, quality, secret_scan, simhash, toxicity, warc
from tonewright.llm.sql import SQL
from tonewright.llm.text import table

TOKENIZERS = "/opt/tokenizers"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return clean.select(
        "doc_id",
        F.col("_lines").cast("long").alias("n_lines"),
        F.col("_exact").cast("long").alias("n_exact"),
        F.col("_near").cast("long").alias("n_near"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (toxicity.in_fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents")).drop("distance")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secret_scan.BASE + secret_scan.MORE
    found = secret_scan.spans(table(spark, sf_dir, "documents"), rules)
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind_no"] == k)).cast("long")
    base = secret_scan.as_text(F.filter("spans", lambda x: x["kind_no"] < len(secret_scan.BASE)), rules)
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{r.kind}") for k, r in enumerate(secret_scan.BASE)],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secret_scan.as_text(F.col("spans"), rules).alias("spans"),
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = chat.perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return each.withColumn("mask", mask)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.schedule(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, table(spark, sf_dir, "pages"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.postings(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_print.neighbours(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), alignment.pair_of(TOKENIZERS))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_dedup, op2_toxicity, op3_decontamination, op4_licenses, op5_quality, op6_secrets, op7_chat, op8_mixing, op9_simhash, op10_warc, op11_lexical, op12_fingerprints, op13_alignment)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return SQL
