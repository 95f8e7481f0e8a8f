"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and every other as a named user; turns of `system` set the scene and stay system turns.
The mask marks, in code points of the rendering, what the assistant learns: its texts and the marks
that end them.

Turns are ordered by their number (null first), then by role and text, so ties and repeated rows
have a definite order; each row is a turn. A null or blank role is the speaker "unknown"; a null
text is empty. Marks of the format inside texts are broken up by a space, so a text can't forge a
turn. Names keep letters, digits, - and _; other characters become _. A conversation of system
turns only has no participant and gives no row; an empty table gives none. A row with a null conv_id
is a conversation of its own, as nothing tells which rows belong together. Long texts and dialogues
are rendered whole. Other columns are ignored. One rendering is one row, so a conversation's turns
meet in one place; nothing else does, and a conversation is as long as its rendering may be. No
Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.llm.text import running_sums, trimmed

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _safe(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for mark in (START, END):
        text = F.replace(text, F.lit(mark), F.lit(mark[:1] + " " + mark[1:]))
    return text


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, n_turns, n_learnt, text and mask, an array of (start, end)."""
    role = trimmed(F.col("role"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    talk = turns.select(
        "conv_id", alone.alias("alone"), F.struct("turn", F.when(role == "", "unknown").otherwise(role).alias("role"), _safe(F.col("text")).alias("text")).alias("t")
    )
    talk = talk.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    speakers = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r != SYSTEM))
    each = talk.select("conv_id", "turns", F.explode(speakers).alias("speaker"))

    def head(t: Column) -> Column:
        name = F.regexp_replace(t["role"], r"[^\p{L}\p{N}_-]", "_")
        who = (
            F.when(t["role"] == SYSTEM, F.lit("system"))
            .when(t["role"] == F.col("speaker"), F.lit("assistant"))
            .otherwise(F.concat(F.lit("user name="), name))
        )
        return F.concat(F.lit(START), who, F.lit("\n"))

    parts = each.withColumn(
        "parts",
        F.transform(
            "turns",
            lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == F.col("speaker")).alias("own")),
        ),
    ).drop("turns")
    parts = parts.withColumn("sizes", F.transform("parts", lambda p: (F.length(p["head"]) + F.length(p["body"]) + 1).cast("long")))
    parts = parts.withColumn("starts", running_sums(F.col("sizes")))
    mask = F.transform(
        F.filter(
            F.zip_with(
                "parts", "starts", lambda p, s: F.struct(p["own"].alias("own"), (s + F.length(p["head"])).alias("start"), (s + F.length(p["head"]) + F.length(p["body"])).alias("end"))
            ),
            lambda x: x["own"],
        ),
        lambda x: F.struct(x["start"], x["end"]),
    )
    return parts.select(
        "conv_id",
        "speaker",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_learnt"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        mask.alias("mask"),
    )
