"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are cut into blocks; two that differ in at most d bits agree on all but d of the
blocks, so every choice of blocks less d is a join key. Candidates that share a key are verified by
their Hamming distance. Work is on distinct fingerprints, so exact copies cost nothing more.

A key that very many fingerprints share isn't joined pair by pair. There, each fingerprint emits
itself and itself with one of the bits flipped: two that differ in at most two bits meet in
one of these, all that meet in one differ in at most two, and a star to the least of them keeps
the components whole. That exact way is for d = 2, the default.

Nulls, empty texts and texts of white space have fingerprint zero and link like any other. A text
of fewer words than a shingle is one shingle; a long one is hashed whole, in chunks of bounded memory.
A bit set in half of the hashes is 0. Repeated rows get the same result. A null doc_id never names a
component unless all its rows have none. An empty table gives an empty one. Other columns are
ignored, or kept as they are where documents are returned.

Documents alike by words (`without_alike`, for whole documents): fingerprints of word shingles lie 2 to 11 bits apart at
a five-word similarity of 0.8, too far for blocks. Fingerprints of single words, each by the root of its count, lie 0 to 6 bits
apart there. Several such fingerprints, of unlike hashes, are cut into blocks; a pair that is within d bits in any of them is
verified by the Jaccard similarity of its sets of five-word shingles. Keys of up to pairwise documents are joined pair by
pair. In a crowded key all are compared to a few leaders, those found alike are represented by one and leave, and the rest goes
into the next round; after a round that hardly helps, only pairs within d bits that share one of their rarest shingles meet, which loses none. So of two documents that stay none are alike,
if any fingerprint shows it. Texts of fewer words than a shingle and rows without a doc_id take no part.

A key or a fingerprint with very many rows is never collected: counts and minima are partial
aggregates. Rows only meet by key again in joins to one row a key, which adaptive execution splits.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.graph import components
from tonewright.llm.storage import settled, small
from tonewright.llm.text import n_words, row_key

CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 majority bits of the XXH64 of all word shingles; a tie gives 0."""
    import xxhash

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and split know ASCII only
    if not ws:
        return 0
    n = max(1, len(ws) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(ws[i : i + width]), 42) for i in range(at, min(n, at + CHUNK))), np.uint64
        )
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, width: int = 3, *carry: str) -> DataFrame:
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.select("doc_id", *carry, fp("text").alias("fp"))


def _keys(blocks: int, d: int) -> list[int]:
    """Masks of all choices of blocks less d."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(part[i] for i in kept) for kept in combinations(range(blocks), blocks - d)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, blocks: int = 5, d: int = 2, pairwise: int = 32) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct prints (fp) within d bits.

    Keys with up to pairwise prints are joined pair by pair.
    """
    if d != 2:
        raise ValueError("the exact way for crowded keys is for two bits")
    masks = [_signed(m) for m in _keys(blocks, d)]
    keyed = settled(
        prints.select(
            "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key")
        ),
        "blocks",
    )
    crowd = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = settled(keyed.join(crowd, ["mask", "key"]), "shared-blocks")
    few = shared.filter(F.col("n") <= pairwise).drop("n")
    pairs = (
        few.withColumnRenamed("fp", "a")
        .join(few.withColumnRenamed("fp", "b"), ["mask", "key"])
        .filter("a < b AND bit_count(a ^ b) <= 2")
        .select("a", "b")
    )
    flips = F.array(*[F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)]])
    ball = (
        shared.filter(F.col("n") > pairwise)
        .select("fp")
        .distinct()
        .select("fp", F.explode(flips).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    )
    # At most 65 prints have a given neighbour within one bit, so this group is small.
    stars = (
        ball.groupBy("near")
        .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("members"))
        .filter(F.size("members") > 1)
        .select("a", F.explode("members").alias("b"))
        .filter("a < b")
    )
    return pairs.unionByName(stars).distinct()


def _grouped(docs: DataFrame, width: int, blocks: int, pairwise: int, *carry: str) -> DataFrame:
    """doc_id, carry, fp, root (least print of the component) and component_id."""
    each = settled(with_fingerprints(docs, width, *carry), "prints")
    prints = settled(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    roots = components(links(prints.select("fp"), blocks, pairwise=pairwise))
    rooted = settled(
        prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first_id", F.coalesce("root", "fp").alias("root")
        ),
        "roots",
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return each.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp").select("doc_id", *carry, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, blocks: int = 5, pairwise: int = 32) -> DataFrame:
    """doc_id, fp (long) and component_id, the least doc_id reachable by links of at most two bits."""
    return _grouped(docs, width, blocks, pairwise).select("doc_id", "fp", "component_id")


def word_prints(text: str | None, prints: int = 3) -> list[int]:
    """Fingerprints of the words of a text, each word by the root of its count; a sum of zero gives 0."""
    import xxhash

    counts = Counter((text or "").encode("utf-8", "surrogatepass").lower().split())
    sums, found = np.zeros(64 * prints), list(counts.items())
    for at in range(0, len(found), CHUNK // 8):
        part = found[at : at + CHUNK // 8]
        hashes = np.array([[xxhash.xxh64_intdigest(w, seed) for seed in range(prints)] for w, _ in part], np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8), axis=1).astype(np.float64)
        weights = np.rint(256 * np.sqrt([n for _, n in part]))  # whole numbers, so that sums are exact
        sums += 2 * (weights @ bits) - weights.sum()
    return np.packbits(sums > 0).view(">i8").tolist()


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """XXH64 of the distinct word shingles, as signed numbers in ascending order; fewer words than width have none."""
    import xxhash

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(0, len(ws) - width + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(ws[i : i + width]), 42) for i in range(n)), np.uint64, n)).view(np.int64)


def _sets(each: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, *carry: str) -> DataFrame:
    """no, carry and set, the shingles, of the nodes (no). texts: key, text."""

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width) for t in texts], dtype=object)

    need = settled(each.join(nodes, "no").select("no", *carry, "key"), "candidates")
    return settled(texts.join(small(need), "key").select("no", *carry, shingles("text").alias("set")), "shingles")


def _verified(pairs: DataFrame, each: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles have the similarity."""
    sets = _sets(each, pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct(), texts, width)
    both = pairs.join(sets.select(F.col("no").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("no").alias("b"), F.col("set").alias("y")), "b")
    n, m, common = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    alike = (F.least(n, m) >= similarity * F.greatest(n, m)) & (common / (n + m - common) >= similarity)
    return settled(both.filter(alike).select("a", "b"), "alike")


def _by_rare_shingles(nodes: DataFrame, each: DataFrame, texts: DataFrame, width: int, similarity: float, d: int) -> DataFrame:
    """Candidate pairs among the nodes: all that can have the similarity and are within d bits in a fingerprint.

    Two sets of the similarity s share one of their n - ceil(s n) + 1 rarest elements, in any order that is the same for both. So
    only pairs that share one of these shingles meet, however many share a key of words or a common passage.
    """
    sets = _sets(each, nodes, texts, width, "fps")
    words = sets.select("no", F.explode("set").alias("s"))
    shared = settled(words.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1"), "shared-shingles")
    ranked = words.join(small(shared), "s").groupBy("no").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("ranked"))
    size = F.size("set")
    # Shingles of one set alone are its rarest and lead nowhere: they only take their places.
    places = size - F.ceil(size * similarity - 1e-9).cast("int") + 1 - (size - F.size("ranked"))
    rare = sets.join(ranked, "no").select("no", "fps", size.alias("size"), F.explode(F.slice("ranked", 1, F.greatest(places, F.lit(0)))).alias("r"))
    rare = settled(rare.select("no", "fps", "size", F.col("r.s").alias("s")), "rare-shingles")
    left, right = (rare.select("s", F.col("no").alias(x), F.col("fps").alias(f"f{x}"), F.col("size").alias(f"n{x}")) for x in "ab")
    near = F.exists(F.zip_with("fa", "fb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), lambda n: n <= d)
    sized = F.least("na", "nb") >= similarity * F.greatest("na", "nb")
    return settled(left.join(right, "s").filter((F.col("a") < F.col("b")) & sized & near).select("a", "b").distinct(), "rare-pairs")


def _round(keyed: DataFrame, d: int, pairwise: int, leaders: int, turn: int) -> tuple[DataFrame, DataFrame, int]:
    """Candidate pairs of rows (key, no, fp), the crowded keys, and the number of rows in these."""
    groups = settled(
        keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("no").alias("a"), F.max("no").alias("b"), F.bit_xor("fp").alias("x")).filter("n > 1"),
        "word-blocks",
    )
    more = settled(groups.filter("n > 2").select("key", "n"), "shared-word-blocks")
    shared = settled(keyed.join(small(more), "key"), "shared-words")
    crowded = F.col("n") > pairwise
    few, crowd = shared.filter(~crowded), shared.filter(crowded)
    pairs = (
        few.select("key", F.col("no").alias("a"), F.col("fp").alias("fa"))
        .join(few.select("key", F.col("no").alias("b"), F.col("fp").alias("fb")), "key")
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= d))
        .select("a", "b")
    )
    pairs = pairs.unionByName(groups.filter((F.col("n") == 2) & (F.bit_count("x") <= d)).select("a", "b"))
    chosen = [F.min_by(F.struct("no", "fp"), F.xxhash64("no", F.lit(turn), F.lit(k))) for k in range(leaders)]
    led = settled(crowd.groupBy("key").agg(F.array(*chosen).alias("leaders")), "leaders")
    stars = (
        crowd.join(small(led), "key")
        .select("no", "fp", F.explode("leaders").alias("lead"))
        .filter((F.col("no") != F.col("lead.no")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("lead.fp"))) <= d))
        .select(F.least("no", "lead.no").alias("a"), F.greatest("no", "lead.no").alias("b"))
    )
    return settled(pairs.unionByName(stars).distinct(), "word-pairs"), more.filter(crowded).select("key"), crowd.count()


def without_alike(docs: DataFrame, similarity: float = 0.8, width: int = 5, prints: int = 3, d: int = 4, blocks: int = 7, pairwise: int = 32, leaders: int = 4) -> DataFrame:
    """The documents but those alike to one that stays, with all columns: of a group the least doc_id, of equal ones the least hash, stays."""

    @F.pandas_udf("array<long>")
    def fps(texts: pd.Series) -> pd.Series:
        return pd.Series([word_prints(t, prints) for t in texts], dtype=object)

    whole = docs.select(F.struct("*").alias("row"), row_key("doc_id", "text").alias("key"))
    texts = whole.filter(F.col("row.doc_id").isNotNull()).select("key", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    each = settled(
        texts.filter(n_words(F.col("text")) >= width).select("key", "doc_id", fps("text").alias("fps")).withColumn("no", F.monotonically_increasing_id()),
        "word-prints",
    )
    masks = [_signed(m) for m in _keys(blocks, d)]
    alive, keys, found, before, last = each, None, None, None, False
    for turn in count():
        rows = alive.select("no", F.posexplode("fps").alias("t", "fp"))
        keyed = rows.select("no", "fp", F.explode(F.array(*[F.xxhash64("t", F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])).alias("key"))
        if keys is not None:
            keyed = keyed.join(small(keys), "key", "left_semi")
        if last:  # leaders no longer help: unlike documents in one key
            pairs, size = _by_rare_shingles(keyed.select("no").distinct(), each, texts.select("key", "text"), width, similarity, d), 0
        else:
            pairs, crowded, size = _round(keyed, d, pairwise, leaders, turn)
        links = _verified(pairs, each, texts.select("key", "text"), width, similarity)
        if found is None or links.settled_rows:
            found = links if found is None else settled(found.unionByName(links), "links")
            roots = components(found)
        if not size:
            break
        last = before is not None and size > 0.9 * before
        keys, before = settled(crowded, "crowded-keys"), size
        alive = each.join(small(settled(roots.filter("node <> root").select(F.col("node").alias("no")), "represented")), "no", "left_anti")
    grouped = settled(each.join(roots.withColumnRenamed("node", "no"), "no").select("no", "root", F.struct("doc_id", "key").alias("name")), "alike-groups")
    best = grouped.groupBy("root").agg(F.min("name").alias("best"))
    gone = settled(grouped.join(best, "root").filter("name <> best").select("name.key").distinct(), "alike-copies")
    return whole.join(small(gone), "key", "left_anti").select("row.*")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, with all columns: first of those whose fingerprints link, then of those alike by words."""
    return without_alike(one_of_linked(docs))


def one_of_linked(docs: DataFrame) -> DataFrame:
    """The documents with the least doc_id of their group, with all columns; rows without a doc_id stay.

    Rows are told apart by doc_id and text, so unlike texts that share a doc_id are documents of their own.
    Of rows of one doc_id in one group the first by text stays, of equal texts the first by a hash of all columns.
    """
    key = row_key("doc_id", "text")
    whole = docs.select(F.struct("*").alias("row"), key.alias("key"))
    found = settled(_grouped(docs.select("doc_id", "text", key.alias("key")), 3, 5, 32, "key").filter("doc_id IS NOT NULL").select("doc_id", "key", "root", "component_id"), "grouped")
    gone = settled(found.filter("doc_id <> component_id").select("key").distinct(), "copies")
    first = found.filter("doc_id = component_id")
    groups = settled(first.groupBy("doc_id", "root").count().filter("count > 1").select("doc_id", "root"), "repeats")
    left = whole.join(small(gone), "key", "left_anti")
    if groups.isEmpty():
        return left.select("row.*")
    twice = settled(first.join(small(groups), ["doc_id", "root"]).select("key", "root").distinct(), "repeated-rows")
    again = settled(left.join(small(twice), "key").withColumn("no", F.monotonically_increasing_id()), "repeated-documents")
    order = F.struct(F.col("row.text").isNotNull(), F.col("row.text"), F.xxhash64(F.to_json("row")), F.col("no"))
    best = settled(again.groupBy(F.col("row.doc_id").alias("id"), "root").agg(F.min_by("no", order).alias("no")).select("no"), "one-of-repeats")
    once = again.join(small(best), "no", "left_semi").select("row.*")
    return left.join(small(twice), "key", "left_anti").select("row.*").unionAll(once)
