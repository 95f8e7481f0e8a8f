"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.storage import settled


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node that it reaches.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each replaces the
    edges of a node by edges to its least neighbour, until nothing changes. Only two numbers a
    round reach the driver; each round's edges are written out, so lineage stays short. The least
    neighbour comes from a partial aggregate, so a hub's edges are not gathered anywhere.
    """
    now = settled(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(below, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(below.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        now = settled(small, "edges", F.expr("bit_xor(xxhash64(a, b))"))
        mark = now.settled_sums
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
