"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id and text and queued, as often as the source may
repeat. A document's virtual finish time is the number of its source's tokens up to its end, over
the source's target; the mix takes documents in order of this time, over all sources, up to the
total budget. At time 1 every source has its target.

Both running sums (within a source, and over all) are taken in buckets: the sums of the buckets
before, then a window within the bucket. A source with a third of the rows is spread over all its
buckets, as are documents without an id or of one id; only rows equal in id and text share a hash.
Tokens are words, of whole texts however long; a null text has none. Null is a source of its own,
last in order. Ties of the finish time go by source, hash, id and size. Repeated rows count as
documents of their own. An empty table gives an empty mix. Other columns, of whatever name or type,
are kept as they are by `mix`. Sources take one task, with one row each. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.llm.storage import settled
from tonewright.llm.text import free_names, n_words

PER_UNIT = 4096


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """source, source_size, rank, target, budget (the total): shares of the total by weight, of which none is above repeats times its source.

    Filling by weight with the excess given back until none is above gives least(cap, level *
    weight); the level is that of the first source, by cap over weight, which stays below its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    per = per.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "w", F.element_at(F.array(*[F.lit(x).cast("long") for x in cycle]), ((F.col("rank") - 1) % len(cycle) + 1).cast("int"))
    )
    cap = F.col("source_size") * repeats
    order = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    every = Window.partitionBy()
    per = (
        per.withColumn("full", F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest_w", F.sum("w").over(every) - F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("w"))
        .withColumn("left", F.sum("source_size").over(every) - F.col("full"))
        .withColumn("open", cap * F.col("rest_w") >= F.col("w") * F.col("left"))
        .withColumn("level", F.min_by(F.when(F.col("open"), F.col("left") / F.col("rest_w")), F.when(F.col("open"), F.col("full"))).over(every))
    )
    return per.select("source", "source_size", "rank", F.least(cap.cast("double"), F.col("level") * F.col("w")).alias("target"), F.sum("source_size").over(every).alias("budget"))


def schedule(docs: DataFrame, repeats: int = 3, seed: str = "") -> DataFrame:
    """rid, doc_id, size, source_size, target, taken, copies and start, the virtual finish time of the first copy; rid numbers the rows."""
    return _scheduled(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", "text"), repeats, seed)


def _scheduled(docs: DataFrame, repeats: int, seed: str) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sizes = settled(
        docs.select(
            "rid",
            "doc_id",
            "source",
            n_words(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(seed), part("doc_id"), F.lit(":"), part("text")).cast("binary")).alias("key"),
        ),
        "sizes",
    )
    goal = settled(targets(sizes, repeats=repeats), "targets")

    slot: Column = F.substring("key", 1, 3)  # 4096 slots of each source
    slots = sizes.groupBy("source", slot.alias("slot")).agg(F.sum("size").alias("s"))
    before = slots.select(
        F.col("source").alias("slot_source"),
        F.col("slot"),
        (F.sum("s").over(Window.partitionBy("source").orderBy("slot")) - F.col("s")).alias("before"),
    )
    in_slot = Window.partitionBy("source", "slot").orderBy("key", "doc_id", "size", "rid")
    queued = (
        sizes.withColumn("slot", slot)
        .withColumn("within", F.sum("size").over(in_slot.rowsBetween(Window.unboundedPreceding, 0)))
        .join(before, F.col("source").eqNullSafe(F.col("slot_source")) & (before.slot == F.substring("key", 1, 3)))
        .drop("slot_source", "slot")
        .join(goal.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source")))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("finish", F.try_divide(F.col("copy") * F.col("source_size") + F.col("before") + F.col("within"), F.col("target")))
        .withColumn("finish", F.coalesce("finish", F.lit(0.0)))  # a source without a word
        .withColumn("at", F.floor(F.least("finish", F.lit(4.0)) * PER_UNIT))
        .select("rid", "doc_id", "size", "source_size", "target", "rank", "budget", "key", "copy", "finish", "at")
    )
    queued = settled(queued, "queued")
    spans = queued.groupBy("at").agg(F.sum("size").alias("s"))  # at most 4 * PER_UNIT + 1 rows
    spans = spans.select("at", "s", (F.sum("s").over(Window.orderBy("at")) - F.col("s")).alias("ahead"))
    placed = queued.join(F.broadcast(spans), "at")
    edge = (F.col("ahead") < F.col("budget")) & (F.col("ahead") + F.col("s") > F.col("budget"))
    # Spans before and after the one where the budget ends are in or out as a whole; that one is cut as finely
    # again, and only the part of it where the budget ends is sorted.
    fine = placed.filter(edge).withColumn("part", F.floor((F.least("finish", F.lit(4.0)) * PER_UNIT - F.col("at")) * PER_UNIT))
    parts = fine.groupBy("part").agg(F.sum("size").alias("p"), F.first("ahead").alias("span_ahead"))  # at most PER_UNIT rows
    parts = parts.select("part", "p", (F.col("span_ahead") + F.sum("p").over(Window.orderBy("part")) - F.col("p")).alias("part_ahead"))
    fine = fine.join(F.broadcast(parts), "part")
    cut = (F.col("part_ahead") < F.col("budget")) & (F.col("part_ahead") + F.col("p") > F.col("budget"))
    in_part = Window.partitionBy("part").orderBy("finish", "rank", "key", "doc_id", "size", "copy", "rid")
    within = F.sum("size").over(in_part.rowsBetween(Window.unboundedPreceding, 0))
    mixed = (
        placed.filter(~edge)
        .withColumn("in", F.col("ahead") + F.col("s") <= F.col("budget"))
        .unionByName(fine.filter(~cut).withColumn("in", F.col("part_ahead") + F.col("p") <= F.col("budget")).select(*placed.columns, "in"))
        .unionByName(fine.filter(cut).withColumn("in", F.col("part_ahead") + within <= F.col("budget")).select(*placed.columns, "in"))
    )
    return mixed.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum(F.when(F.col("in"), F.col("size")).otherwise(0)).alias("taken"),
        F.sum(F.col("in").cast("int")).alias("copies"),
        F.min("finish").alias("start"),
    )


def mix(docs: DataFrame, repeats: int = 3, seed: str = "") -> DataFrame:
    """The documents that the mix takes, with copies (1 to repeats, how often) and start, their place in the order.

    If documents have columns of these names, the new ones get underscores at their ends.
    """
    copies, start = free_names(docs.columns, "copies", "start")
    rows = settled(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid")), "rows")
    plan = _scheduled(rows.select("rid", "row.doc_id", "row.source", "row.text"), repeats, seed).filter("copies > 0").select("rid", "copies", "start")
    mixed = rows.join(plan, "rid").repartitionByRange(F.col("start")).sortWithinPartitions("start")
    return mixed.select("row.*", F.col("copies").alias(copies), F.col("start").alias(start))
