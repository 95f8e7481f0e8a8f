"""Benchmark decontamination by size-partitioned MinHash containment search.

Both sides are lower-cased runs of letters and digits, in shingles of five words. An item is
contained in a document if at least `least` (80 %) of its distinct shingles occur anywhere in it.
An item of fewer than five words has no shingle: a word or two in a long text are no leak. Such an
item is contained only in a document that has its words and no others.

Items are partitioned by size: partition u holds those of u/2 < n <= u distinct shingles, u a power
of two. The Jaccard similarity of an item and a whole long document would vanish, so for each
partition documents are searched in windows of its size: blocks of u shingles, two next to each
other, so a passage of up to u shingles lies in one window whole. For a partition, containment of
least turns into a Jaccard similarity of an item and its window of s = c / (2u + n - c) or more, c
being ceil(least n) (after Zhu et al., 2016). Both are signed by as many MinHash values as make the
chance that none agrees, (1 - s) to their number, less than `miss`; a window that agrees with an item
in any value makes their document a candidate. The values of a block are minima of those of its
halves, so each shingle is hashed once for all partitions. Candidates are verified by exact
containment over the whole document, so there is no false result; a passage in several pieces is
found by its largest ones, and only shingles strewn singly over a long document may be missed.

The work is one pass over the documents, which are never shuffled. Items are signed by Spark, dealt
into blocks of a bounded size and written to the shared folder; a task reads the block from there,
and a benchmark of more than one block takes a pass for each. Null or wordless items match nothing;
null or empty documents contain nothing; long texts are searched whole. Rows that repeat an item_id,
or a doc_id, are items or documents of their own, and their equal results are returned as often.
Empty tables give an empty result. Other columns are ignored, or kept as they are by `without_leaks`.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.storage import fresh, settled, small
from tonewright.llm.text import row_key

WIDTH = 5
LEAST = 0.8
MISS = 1e-6
BLOCK_CHARS = 4_000_000
TOKEN, BETWEEN = re.compile(r"\w+"), re.compile(r"\W")
FOUND = "item_id long, item_shingles long, shared long, containment double"
ITEM = "item_id long, text string, size int, partition int, signature binary"
# Characters, and MinHash values, that a task works on at once.
MOST_CHARS = 1 << 19
MOST_VALUES = 1 << 22


# Odd multipliers.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache
def _word_characters() -> np.ndarray:
    """Whether each code point is one of TOKEN."""
    return np.fromiter((chr(c).isalnum() or chr(c) == "_" for c in range(0x110000)), bool, 0x110000)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (in lower case), and how many each text has."""
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    inside = _word_characters()[code]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    counts = np.diff(np.searchsorted(np.flatnonzero(begins), ends), prepend=0)
    own = code[inside].astype(np.uint64)
    first = np.flatnonzero(begins[inside])
    if not len(first):
        return np.zeros(0, np.uint64), counts
    at = np.arange(len(own)) - np.repeat(first, np.diff(first, append=len(own)))
    powers = np.cumprod(np.full(int(at.max()) + 1, BASE))
    return _mixed(np.add.reduceat((own + np.uint64(1)) * powers[at], first)), counts


def word_hashes(text: str) -> np.ndarray:
    """Of one text, in pieces that end between words, so that memory goes with the longest piece."""
    out, at = [], 0
    while at < len(text):
        end = at + MOST_CHARS
        if end < len(text):
            cut = BETWEEN.search(text, end)
            end = cut.start() if cut else len(text)
        out.append(_words([text[at:end]])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(ws: list[str], width: int) -> list[str]:
    return [" ".join(ws[i : i + width]) for i in range(len(ws) - width + 1)]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all shingles, in order, from hashes of the words."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, width):
        h = h * BASE + words[k : k + n]
    return _mixed(h)


def needed(n: int, least: float) -> int:
    """Shingles that a document holds at least, of an item of n."""
    return math.ceil(round(least * n, 9))


def partition_of(n: int) -> int:
    """The least power of two that is not below n."""
    return 1 << (n - 1).bit_length()


def n_hashes(u: int, least: float, miss: float) -> int:
    """MinHash values that partition u takes."""
    if u == 1:
        return 1  # an item of one shingle is a window of its own
    s = min(needed(n, least) / (2 * u + n - needed(n, least)) for n in range(u // 2 + 1, u + 1))
    return math.ceil(math.log(miss) / math.log(1 - s))


@lru_cache
def _constants(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of k hash functions; the first ones are the same for every k."""
    draw = np.random.default_rng(2016).integers(0, 1 << 63, (1024, 2), dtype=np.uint64)[:k]
    return draw[:, 0], draw[:, 1] * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k MinHash values of a set of shingle hashes."""
    flip, factor = _constants(k)
    return ((hashes[None, :] ^ flip[:, None]) * factor[:, None]).min(1)


def block_minima(hashes: np.ndarray, starts: np.ndarray, flip: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The least value of each block, one row a hash function."""
    out = np.empty((len(flip), len(starts)), np.uint64)
    for k in range(len(flip)):
        out[k] = np.minimum.reduceat((hashes ^ flip[k]) * factor[k], starts)
    return out


def block_starts(lengths: np.ndarray, u: int) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks of u begin in rows of these lengths set end to end, and the row of each block."""
    n = -(-lengths // u)
    row = np.repeat(np.arange(len(lengths)), n)
    return (np.cumsum(lengths) - lengths)[row] + u * (np.arange(n.sum()) - (np.cumsum(n) - n)[row]), row


class Partition:
    """The MinHash values of a block's items of one partition, sorted, with their items."""

    def __init__(self, values: np.ndarray, items: np.ndarray):
        self.n_hashes = values.shape[1]
        order = np.argsort(values, axis=None)
        self.values, self.items = values.ravel()[order], np.repeat(items, self.n_hashes)[order]
        self.mask = np.uint64((1 << max(12, (16 * len(order)).bit_length())) - 1)
        self.lows = np.zeros(int(self.mask) + 1, bool)  # a value that isn't here by its low bits is none of them (minima share the top ones)
        self.lows[self.values & self.mask] = True

    def hits(self, windows: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) of equal values; windows has a row for a hash function."""
        at = np.nonzero(self.lows[windows & self.mask])
        found = windows[at]
        low, high = np.searchsorted(self.values, found), np.searchsorted(self.values, found, "right")
        for i in np.flatnonzero(high > low).tolist():
            for k in self.items[low[i] : high[i]].tolist():
                yield int(at[1][i]), k


class Index:
    """A block of items: MinHash values by partition, and the texts that verify."""

    def __init__(self, items: list[tuple[int | None, str, int, int, bytes]], width: int, least: float):
        self.width, self.least, self.items = width, least, items
        #: Items of fewer words than a shingle.
        self.short: dict[str, list[int]] = defaultdict(list)
        self._own: dict[int, set[str]] = {}
        by_size = defaultdict(list)
        for k, (_, text, _, u, _) in enumerate(items):
            if u:
                by_size[u].append(k)
            else:
                self.short[" ".join(TOKEN.findall(text.lower()))].append(k)
        self.parts = {u: Partition(np.stack([np.frombuffer(items[k][4], np.uint64) for k in own]), np.array(own)) for u, own in sorted(by_size.items())}

    def shingles_of(self, k: int) -> set[str]:
        if k not in self._own:
            self._own[k] = set(shingles(TOKEN.findall(self.items[k][1].lower()), self.width))
        return self._own[k]

    def candidates(self, docs: list[np.ndarray]) -> list[set[int]]:
        """For each document, by the hashes of its shingles: items one of whose MinHash values is that of a window."""
        hits: list[set[int]] = [set() for _ in docs]
        lengths = np.array([len(h) for h in docs], np.int64)
        if not lengths.sum() or not self.parts:
            return hits
        hashes, unit = np.concatenate(docs), min(self.parts)
        starts, row = block_starts(lengths, unit)
        flip, factor = _constants(max(p.n_hashes for p in self.parts.values()))
        step = max(1, MOST_VALUES // len(starts))
        for first in range(0, len(flip), step):
            own = slice(first, first + step)
            minima = block_minima(hashes, starts, flip[own], factor[own])
            n_units = np.bincount(row, minlength=len(docs))
            for u, part in self.parts.items():
                rows_left = part.n_hashes - first
                if rows_left <= 0:
                    continue
                at, of = (np.arange(len(starts)), row) if u == unit else block_starts(n_units, u // unit)
                blocks = minima[:rows_left] if u == unit else np.minimum.reduceat(minima[:rows_left], at, axis=1)
                if u > 1 and len(of) > 1:
                    blocks, one = blocks.copy(), of[1:] == of[:-1]
                    blocks[:, :-1] = np.where(one, np.minimum(blocks[:, :-1], blocks[:, 1:]), blocks[:, :-1])
                for window, k in part.hits(blocks):
                    hits[of[window]].add(k)
        return hits

    def search(self, texts: list[str | None]) -> list[list[tuple[int | None, int, int]]]:
        """For each text, (item_id, shingles, shared) of the items that it contains."""
        found: list[list[tuple[int | None, int, int]]] = []
        pending, chars = [], 0
        for text in texts:
            low = (text or "").lower()
            if chars and chars + len(low) > MOST_CHARS:
                found += self._search(pending)
                pending, chars = [], 0
            pending.append(low)
            chars += len(low)
        return found + self._search(pending)

    def _search(self, texts: list[str]) -> list[list[tuple[int | None, int, int]]]:
        if len(texts) == 1:  # it may be a long one
            docs = [word_hashes(texts[0])]
        else:
            words, counts = _words(texts)
            docs = np.split(words, np.cumsum(counts)[:-1])
        out = []
        for low, own_words, hits in zip(texts, docs, self.candidates([shingle_hashes(w, self.width) for w in docs]), strict=True):
            found = []
            if 0 < len(own_words) < self.width:
                found = [(self.items[k][0], 1, 1) for k in self.short.get(" ".join(TOKEN.findall(low)), ())]
            have = set(shingles(TOKEN.findall(low), self.width)) if hits else set()
            for k in sorted(hits):
                own = self.shingles_of(k)
                shared = len(own & have)
                if shared >= needed(len(own), self.least):
                    found.append((self.items[k][0], len(own), shared))
            out.append(found)
        return out


def signed_items(items: DataFrame, width: int = WIDTH, least: float = LEAST, miss: float = MISS) -> DataFrame:
    """item_id, text, size (distinct shingles), partition (0: fewer words than a shingle) and signature of the items with a word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = word_hashes(text.lower())
                hashes = np.unique(shingle_hashes(ws, width))
                n = len(hashes)
                if len(ws):
                    u = partition_of(n) if n else 0
                    rows.append((item_id, text, n, u, signature(hashes, n_hashes(u, least, miss)).tobytes() if n else b""))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary())
            names = [x.split()[0] for x in ITEM.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sign, ITEM)


@lru_cache(maxsize=1)
def _loaded(where: str, width: int, least: float) -> Index:
    """The index of a block; a worker keeps the last one that it read."""
    fs, path = pafs.FileSystem.from_uri(where)
    rows = pads.dataset(path, filesystem=fs, format="parquet").to_table([x.split()[0] for x in ITEM.split(", ")])
    return Index(list(zip(*[c.to_pylist() for c in rows.columns], strict=True)), width, least)


def _pairs(docs: DataFrame, items: DataFrame, keys: list[str], width: int = WIDTH, least: float = LEAST, block_chars: int = BLOCK_CHARS, miss: float = MISS) -> DataFrame:
    """keys, item_id, item_shingles, shared, containment of every document (keys, text) and item at least that contained."""
    spark = docs.sparkSession
    signed = settled(signed_items(items, width, least, miss), "items")
    own = docs.select(*keys).schema.simpleString().removeprefix("struct<").removesuffix(">")
    schema = f"{own}, {FOUND}"
    if not signed.settled_rows:
        return spark.createDataFrame([], schema)
    blocks = 1 + signed.agg(F.sum(F.length("text"))).first()[0] // block_chars
    where = fresh(spark, "benchmark")
    # Dealt by the settled rows' numbers, so items of one text don't land together.
    dealt = signed.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    dealt.repartition("block").write.partitionBy("block").parquet(where)
    found = []
    for (block,) in spark.read.parquet(where).select("block").distinct().collect():  # one number for each block_chars

        def scan(batches: Iterator[pa.RecordBatch], path: str = f"{where}/block={block}") -> Iterator[pa.RecordBatch]:
            index = _loaded(path, width, least)
            for batch in batches:
                rows = [(at, *hit) for at, hits in enumerate(index.search(batch.column(len(keys)).to_pylist())) for hit in hits]
                at, item, size, shared = (pa.array([r[k] for r in rows], pa.int64()) for k in range(4))
                share = pa.array([r[3] / r[2] for r in rows], pa.float64())
                names = [*keys, *[x.split()[0] for x in FOUND.split(", ")]]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(len(keys))], item, size, shared, share], names)

        found.append(docs.select(*keys, "text").mapInArrow(scan, schema))
    return reduce(DataFrame.unionByName, found)


def contained(docs: DataFrame, items: DataFrame, width: int = WIDTH, least: float = LEAST, block_chars: int = BLOCK_CHARS, miss: float = MISS) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment of every pair at least that contained; an item of under width words counts as one shingle."""
    return _pairs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, ["doc_id"], width, least, block_chars, miss)


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows whose own text contains no item, with all columns, whatever other rows share their doc_id (null too)."""
    key = row_key("text")
    found = _pairs(docs.select(key["k1"].alias("k1"), key["k2"].alias("k2"), "text"), items, ["k1", "k2"])
    leaks = settled(found.select("k1", "k2").distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("row"), key["k1"].alias("k1"), key["k2"].alias("k2"))
    return rows.join(small(leaks), ["k1", "k2"], "left_anti").select("row.*")
