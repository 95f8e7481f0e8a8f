"""Ranked lexical search: postings in term buckets, integer scores, the best documents of each item.

`postings` turns documents into rows (bucket, term, doc, doc_id, tf, n), and a row of the empty term for
each document that has a term, with its length as tf. `search` keeps the postings of the items'
terms, settles them bucket by bucket, takes the statistics from them and scores: each match gives
weight times impact, summed by item and document, and a window keeps the best.

Terms are runs of characters that are no ASCII punctuation, blanks or controls; A-Z count as a-z. All
but the weight (a logarithm in doubles, rounded down) is integer arithmetic, so sums have no order.

Null or empty texts have no terms: such documents aren't counted, such items find nothing. Every row is
a document or an item of its own, repeated ids and repeated rows too. Equal scores go by ascending doc_id, a null one
last. Texts of any length are taken whole. An empty table on either side gives an empty result; other
columns are ignored.

A term that very many documents hold is dealt by bucket and document, so no task gets all its
postings; those of the items' terms are then dealt by document, so that the sums over the matches need no
shuffle and only each task's best rows of an item go on. The items' terms are broadcast if they are few (counted
when settled), else joined by shuffle.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.llm.storage import settled, small

#: Bytes of a text as terms have them: letters and digits of ASCII in lower case and all bytes of other characters stay.
_KEPT = bytes(
    b if b >= 0x80 or chr(b) in string.digits + string.ascii_lowercase else b + 32 if chr(b) in string.ascii_uppercase else 0x20 for b in range(256)
)


def term_counts(text: str | None) -> Counter[bytes]:
    """The terms of a text in UTF-8, with the number of times that each occurs."""
    return Counter((text or "").encode("utf-8", "surrogatepass").translate(_KEPT).split())


def _posted(batches: Iterable[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, term, tf, n) of batches (row, id, text), with each document's own row of the empty term."""
    for batch in batches:
        rows, ids, terms, tf, sizes = [], [], [], [], []

        def told() -> pa.RecordBatch:
            places = pa.array(ids, pa.int32())
            columns = [pa.array(rows, pa.int64()), batch.column("id").take(places), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64()), pa.array(sizes, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["doc", "doc_id", "term", "tf", "n"])

        for k, (row, text) in enumerate(zip(batch.column("row").to_pylist(), batch.column("text"), strict=True)):
            counts = term_counts(text.as_py())
            n = counts.total()
            if not n:
                continue
            size = len(counts) + 1
            rows += [row] * size
            ids += [k] * size
            terms += [b"", *counts]
            tf += [n, *counts.values()]
            sizes += [n] * size
            if len(rows) >= most:
                yield told()
                rows, ids, terms, tf, sizes = [], [], [], [], []
        if rows:
            yield told()


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")


def postings(docs: DataFrame, buckets: int = 64) -> DataFrame:
    """bucket, term, doc (the row), doc_id, tf, n (the document's terms with repeats). The empty term stands for the document itself."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), "text")
    found = rows.mapInArrow(_posted, f"doc long, doc_id {kind}, term string, tf long, n long")
    return found.select(_bucket(buckets), "term", "doc", "doc_id", "tf", "n")


def write_index(docs: DataFrame, path: str, buckets: int = 64, spread: int = 16) -> None:
    """The postings of all terms as a folder with a subfolder for each bucket, sorted by term: a search reads its terms' buckets only."""
    dealt = postings(docs, buckets).repartition(F.col("bucket"), F.pmod("doc", F.lit(spread)))
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def search(posted: DataFrame, items: DataFrame, k: int = 20, buckets: int = 64, spread: int = 16) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents. posted is of `postings` or read from `write_index`, with as many buckets."""
    asked = settled(postings(items.select(F.col("item_id").alias("doc_id"), "text"), buckets).select("bucket", "term", F.col("doc").alias("item"), F.col("doc_id").alias("item_id"), F.col("tf").alias("times")), "item-terms")
    # The empty term is wanted even if no item has any.
    none = asked.sparkSession.range(1).select(F.lit("").alias("term")).select(_bucket(buckets), "term")
    wanted = settled(asked.select("bucket", "term").unionByName(none).distinct(), "wanted-terms")
    own = posted.join(small(wanted), ["bucket", "term"], "left_semi")
    kept = settled(own.repartition(F.col("bucket"), F.pmod("doc", F.lit(spread))).sortWithinPartitions("bucket", "term"), "postings")

    counts = settled(kept.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")), "term-statistics")
    whole = counts.filter("term = ''").first()
    docs, length = (whole["df"], whole["all"]) if whole else (0, 1)
    weight = F.floor(F.lit(1000.0) * F.log((2 * F.lit(docs).cast("double") + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = settled(asked.filter("term <> ''").join(small(counts), ["bucket", "term"]).select("bucket", "term", "item", "item_id", (F.col("times") * weight).alias("weight")).filter("weight > 0"), "item-weights")

    m = f"(75L + (25L * n * {docs}L) div {length}L)"
    impact = F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * {m})")
    matches = kept.filter("term <> ''").select("bucket", "term", "doc", "doc_id", impact.alias("impact"))
    scores = (
        matches.repartition("doc")
        .join(small(weighed), ["bucket", "term"])
        .groupBy("item", "item_id", "doc", "doc_id")
        .agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
        .filter("score > 0")
    )
    best = Window.partitionBy("item", "item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
