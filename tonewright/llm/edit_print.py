"""Fingerprints of documents by a randomised edit embedding (Chakraborty, Goldenberg, Koucky 2016), bit-sampled bands and verification.

A walk reads a text step by step. At each step the same coins for all texts say, for the character where the walk
stands, whether it moves on; the embedding is the character at each step. Two texts walk alike up to an edit and
soon meet again behind it, so a small edit distance becomes a small Hamming distance. A fingerprint samples LANES
steps of the walk and keeps four bits of the character at each. A lane's step is uniform over the walk and the same for walks
of like length (the last record of a fixed sequence), so texts of any length compare; the share of lanes that agree is
the likeness of two fingerprints, 1/16 or little more for unlike texts.

`near_pairs` joins the fingerprints on bands of sampled lanes and keeps pairs whose likeness reaches a bound, then (given
texts) verifies them by edit distance.

A null text is empty; texts without characters share the fingerprint of no step. Equal texts have equal fingerprints, whatever
else the rows hold. Texts are walked to their end, in pieces of bounded memory. The next document is the one with the next
smaller doc_id; rows of one doc_id follow by a hash of the text, rows without one come last, and equal rows may stand in either
order. After the last comes the first; a document that is alone follows itself. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.llm.storage import settled

LANES = 128
CLASSES = 64
PERIOD = 4096  # of the coins
PIECE = 1 << 18  # characters walked at once
SEED = 20160618


@lru_cache(4)
def _coins(seed: int) -> list:
    """The walk as an automaton: nodes[step][class] is the node after the step at which a character of the class is left; entry CLASSES is the step."""
    heads = np.random.default_rng(seed).random((PERIOD, CLASSES)) < 0.5
    nodes = [[None] * CLASSES + [k] for k in range(PERIOD)]
    for c in range(CLASSES):
        after = int(np.flatnonzero(heads[:, c])[0])  # the next head, from the end of the period backwards
        for k in range(PERIOD - 1, -1, -1):
            after = k if heads[k, c] else after
            nodes[k][c] = nodes[(after + 1) % PERIOD]
    return nodes


@lru_cache(4)
def _places(seed: int, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Steps that lanes sample, ascending, and their lanes. Of a walk of n steps a lane takes its last one before n, which is uniform over the n."""
    draw = np.random.default_rng([seed, 1])
    found = []
    for lane in range(LANES):
        at = 0
        while at < most:
            found.append((at, lane))
            at = max(at + 1, int((at + 1) / (1 - draw.random())))
    found.sort()
    return np.array([x for x, _ in found], np.int64), np.array([x for _, x in found], np.int64)


@lru_cache(4)
def _salts(seed: int) -> np.ndarray:
    return np.random.default_rng([seed, 2]).integers(0, 1 << 32, LANES, np.uint32) | np.uint32(1)


class Walk:
    """Walks over the text that it is fed; `copy` lets two texts share what they begin with."""

    def __init__(self, seed: int = SEED):
        self.seed, self.node, self.step = seed, _coins(seed)[0], 0
        self.taken = np.zeros(LANES, np.uint8)  # four bits of the character at the last place of each lane so far

    def copy(self) -> Walk:
        other = Walk(self.seed)
        other.node, other.step, other.taken = self.node, self.step, self.taken.copy()
        return other

    def feed(self, text: str) -> Walk:
        for at in range(0, len(text), PIECE):
            self._piece(text[at : at + PIECE])
        return self

    def _piece(self, text: str) -> None:
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        mixed = chars * np.uint32(2654435761)
        mixed ^= mixed >> np.uint32(15)
        path = list(accumulate((mixed & np.uint32(CLASSES - 1)).astype(np.uint8).tobytes(), getitem, initial=self.node))
        at = np.fromiter(map(itemgetter(CLASSES), path), np.int64, len(path))
        left = self.step + np.cumsum((np.diff(at) - 1) % PERIOD + 1)  # the step after the last one on each character
        places, lanes = _places(self.seed)
        lo, hi = np.searchsorted(places, [self.step, left[-1]])
        there = mixed[np.searchsorted(left, places[lo:hi], "right")]
        # A lane's places ascend, so its last one in the piece stays.
        self.taken[lanes[lo:hi]] = there * _salts(self.seed)[lanes[lo:hi]] >> np.uint32(28)
        self.node, self.step = path[-1], int(left[-1])

    def print(self) -> np.ndarray:
        return self.taken


def fingerprint(text: str | None, seed: int = SEED) -> np.ndarray:
    """Four bits of each lane."""
    return Walk(seed).feed(text or "").print()


def as_hex(fingerprint: np.ndarray) -> str:
    return (fingerprint[::2] << 4 | fingerprint[1::2]).tobytes().hex()


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    return float((one == other).mean())


def prints(docs: DataFrame, *carry: str, walks: int = 1) -> DataFrame:
    """doc_id, carry, fingerprint, and `again`, the fingerprints of further walks with other coins."""

    @F.pandas_udf("array<string>")
    def fp(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [as_hex(fingerprint(t, SEED + k)) for k in range(walks)])

    found = docs.select("doc_id", *carry, fp(F.coalesce("text", F.lit(""))).alias("each_walk"))
    return found.select("doc_id", *carry, F.col("each_walk")[0].alias("fingerprint"), F.slice("each_walk", 2, walks).alias("again"))


# Bands


@lru_cache(4)
def _bands(bands: int, width: int, seed: int = SEED) -> list[list[int]]:
    draw = np.random.default_rng([seed, 3])
    return [sorted(draw.choice(LANES, width, replace=False).tolist()) for _ in range(bands)]


def likeness_of(one: Column | str, other: Column | str) -> Column:
    """The same for columns of hexadecimal fingerprints: a lane is a digit."""
    same = F.zip_with(F.split(one, ""), F.split(other, ""), lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.lit(float(LANES))


def near_pairs(prints: DataFrame, at_least: float = 0.6, bands: int = 64, width: int = 8, crowd: int = 64) -> DataFrame:
    """a, b, likeness for distinct fingerprints a < b that share a band and are alike in at_least of the lanes.

    Work is on distinct fingerprints, so copies cost nothing more (join the pairs to the rows of a fingerprint for membership). A band's
    key that over crowd fingerprints share is cut into parts, and each pair of parts is compared by its own task:
    no pair is lost, none but those that are alike are emitted, and no task gets a whole crowd.
    """
    distinct = settled(prints.select("fingerprint").distinct(), "distinct-prints")
    digits = [F.concat(*[F.substring("fingerprint", k + 1, 1) for k in lanes]) for lanes in _bands(bands, width)]
    keyed = settled(distinct.select("fingerprint", F.posexplode(F.array(*digits)).alias("band", "key")), "bands")
    sizes = keyed.groupBy("band", "key").agg(F.ceil(F.count("*") / crowd).cast("int").alias("parts"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = settled(keyed.join(sizes, ["band", "key"]).withColumn("part", F.pmod(F.xxhash64("fingerprint"), "parts").cast("int")), "shared-bands")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    low = shared.select("band", "key", F.col("fingerprint").alias("x"), F.explode(F.transform(every, lambda k: F.struct(F.col("part").alias("i"), k.alias("j")))).alias("cell"))
    high = shared.select("band", "key", F.col("fingerprint").alias("y"), F.explode(F.transform(every, lambda k: F.struct(k.alias("i"), F.col("part").alias("j")))).alias("cell"))
    alike = low.join(high, ["band", "key", "cell"]).filter("x < y").withColumn("likeness", likeness_of("x", "y")).filter(F.col("likeness") >= at_least)
    return alike.select(F.col("x").alias("a"), F.col("y").alias("b"), "likeness").distinct()


def near_documents(docs: DataFrame, similarity: float = 0.8, at_least: float = 0.4, walks: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, distance) of distinct texts whose edit distance is within 1 - similarity of the longer one, by class; and doc_id, class of all rows.

    A class is the texts of one fingerprint; its text is the least one. Candidates reach the likeness at_least on one of some walks: an edit
    may keep two walks apart for long, but seldom several with coins of their own.
    """
    each = settled(prints(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", walks=walks), "text-prints")
    heads = settled(each.groupBy("fingerprint").agg(F.min("text").alias("text"), F.min("again").alias("again")), "print-texts")
    found = near_pairs(heads, at_least).select("a", "b")
    for k in range(walks - 1):
        own = heads.select(F.col("again")[k].alias("own"), "fingerprint")
        pairs = near_pairs(own.select(F.col("own").alias("fingerprint")), at_least)
        one, other = own.select(F.col("own").alias("a"), F.col("fingerprint").alias("x")), own.select(F.col("own").alias("b"), F.col("fingerprint").alias("y"))
        named = pairs.join(one, "a").join(other, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        found = found.unionByName(named)
    texts = heads.select(F.col("fingerprint").alias("a"), F.col("text").alias("x")), heads.select(F.col("fingerprint").alias("b"), F.col("text").alias("y"))
    most = F.floor(F.round((1 - similarity) * F.greatest(F.length("x"), F.length("y")), 6)).cast("int")
    both = found.distinct().join(texts[0], "a").join(texts[1], "b").withColumn("most", most)
    near = both.filter(F.abs(F.length("x") - F.length("y")) <= F.col("most")).withColumn("distance", F.levenshtein("x", "y"))
    return near.filter("distance <= most").select("a", "b", "distance"), each.select("doc_id", F.col("fingerprint").alias("class"))


# The next document

KEY = ("late", "turned", "hash", "row")


def _keyed(docs: DataFrame) -> DataFrame:
    """Columns that order rows: those without a doc_id last, descending ids, then a hash of the text and the row."""
    return docs.select(
        F.col("doc_id").isNull().cast("long").alias("late"),
        F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(0)).alias("turned"),
        F.xxhash64("text").alias("hash"),
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "text",
    )


def _edges(keys: DataFrame, blocks: int) -> list[tuple]:
    """The first key of each of at most so many ranges of the keys: only these reach the driver."""
    dealt = keys.repartitionByRange(blocks, *KEY).select(F.struct(*KEY).alias("key"), F.spark_partition_id().alias("range"))
    return sorted(tuple(r.first) for r in dealt.groupBy("range").agg(F.min("key").alias("first")).collect())


def with_next(docs: DataFrame, run, schema: str, blocks: int | None = None) -> DataFrame:
    """run(rows, nexts) over batches of documents (doc_id, text), each with the text of the next one.

    The keys alone are ordered first, to find the edges of ranges; then each row goes to its range with its text, and the first of a
    range to the one before as well. So texts are shuffled once, and ranges are as even as the keys, however often an id occurs. docs must
    give the same rows each time that it is read, as files do.
    """
    spark = docs.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _keyed(docs)
    edges = _edges(rows.select(*KEY), blocks)
    n = len(edges)

    @F.pandas_udf("array<int>")
    def ranges(late: pd.Series, turned: pd.Series, hashed: pd.Series, row: pd.Series) -> pd.Series:
        """A row's range; for a range's first row also that of the range before, as minus one less it."""
        out = []
        for key in zip(late, turned, hashed, row, strict=True):
            k = bisect_right(edges, key) - 1
            out.append([k, -1 - (k - 1) % n] if key == edges[k] else [k])
        return pd.Series(out)

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by range and key, the first of the next range behind them."""
        held = None
        for batch in batches:
            told = []
            for r in zip(*(batch.column(k).to_pylist() for k in ("range", "copy", "doc_id", "text")), strict=True):
                if held is not None:
                    if held[0] != r[0]:
                        raise RuntimeError("a range lacks the row behind it: the documents changed between two reads")
                    told.append((held[2], held[3], r[3]))
                held = None if r[1] else r
            if told:
                yield from run(told)
        if held is not None:
            raise RuntimeError("a range lacks the row behind it: the documents changed between two reads")

    dealt = rows.withColumn("to", F.explode(ranges(*KEY))).select(F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("range"), (F.col("to") < 0).alias("copy"), *KEY, "doc_id", "text")
    ordered = dealt.repartition(max(n, 1), "range").sortWithinPartitions("range", "copy", *KEY)
    return ordered.select("range", "copy", "doc_id", "text").mapInArrow(linked, schema)


def edited(text: str, following: str) -> tuple[str, str]:
    """What stays of a text whose last third is replaced, and what replaces it: as many of the first characters of the next text, or all."""
    k = len(text) // 3
    return text[: len(text) - k], following[:k]


def neighbours(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, shared_bands.

    near_*: likeness of a text's fingerprint to that of the edited text and of the next one. shared_bands: bands in which a text and its
    edited one meet. A text walks once: the edited one continues from what both begin with.
    """
    lanes = np.array(_bands(64, 8))

    def walked(text: str) -> tuple[np.ndarray, Walk]:
        """The fingerprint, and the walk where the last third begins."""
        walk = Walk().feed(edited(text, "")[0])
        return walk.copy().feed(text[len(text) - len(text) // 3 :]).print(), walk

    def run(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out, known = [], {}
        for doc_id, text, after in rows:
            text, after = text or "", after or ""
            kept, put = edited(text, after)
            own, upto_kept = known.get(text) or walked(text)
            known = {text: (own, upto_kept)}
            if after not in known:
                known[after] = walked(after)  # the next row's own text
            following = known[after][0]
            other = upto_kept.feed(put).print() if text != after else upto_kept.copy().feed(put).print()
            out.append((doc_id, len(text), hashlib.sha256((kept + put).encode("utf-8", "surrogatepass")).hexdigest(), as_hex(own), as_hex(other), likeness(own, other), likeness(own, following), int((own[lanes] == other[lanes]).all(1).sum())))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(NEIGHBOURS))

    schema = ", ".join(f"{k} {v}" for k, v in NEIGHBOURS.items())
    return with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema, blocks)


NEIGHBOURS = {"doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double", "shared_bands": "long"}
