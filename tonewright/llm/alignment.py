"""Cross-tokenizer alignment by elementary intervals.

Two tokenizers cut the same bytes. The union of both arrays of token ends cuts them into elementary
intervals; a binary search in either array names the token that owns one. Each interval is the overlap
of one pair of tokens (a link), and each overlap is one interval. Ends that both share close the groups; the product
of a group's tokens is what it expands to (`n_products`).

    blocks = encoded(docs, pair_of(folder))     # settle it: each text is tokenized once
    aligned(blocks)                             # a row for each document

`encoded` works in blocks of a bounded number of characters (one text may exceed it: a text is never cut). In a block, texts
are cut at single spaces where no token of either kind crosses them, and each distinct unit (a word, mostly) is encoded and
aligned once. A block keeps its own numbering of id pairs and how often each is linked, so what is shuffled to
count the pairs of the corpus is a row for each block and pair, and no pair, however frequent, has more rows than
there are blocks. The counts come back by the same rows and meet their block. The best count of an id of the second tokenizer goes to a
table of at most one row for each of its ids, which is broadcast as long as it is small.

A text that is null or empty, or whose tokens joined aren't a space and the text byte by byte, has
no tokens: its numbers are 0 and its groups ''. Special tokens in a text are plain text. Repeated rows are rows of their own and
count each. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.storage import settled, small

BLOCK_CHARS = 4_000_000
LONG_BLANK = re.compile(r"\s{10000}")

#: A single space between characters that are no white space.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")

# Fixed value: the split of the public byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Coder:
    """encode gives the ids of each text behind a space, pieces the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    pieces: list[bytes]
    by_word: bool  # no token goes over a single space between characters that are no white space

    def __post_init__(self):
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        names = [str(k) for k in range(len(self.pieces))]
        self.inner = np.array([x + "," for x in names], object)
        self.bars = np.array([x + "|" for x in names], object)
        self.ends = np.array([x + ";" for x in names], object)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow at 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(8)
def byte_bpe(path: str) -> Coder:
    """A byte-level BPE of the tokenizers library. Each text is encoded behind a space.

    Where ids follow the order of merges, as in public vocabularies, they are ranks, and tiktoken finds the same tokens faster.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    letters = _byte_letters()
    vocabulary, special = model["model"]["vocab"], {t["content"] for t in model["added_tokens"]}
    pieces = [b""] * (max([*vocabulary.values(), *(t["id"] for t in model["added_tokens"])]) + 1)
    for t in model["added_tokens"]:
        pieces[t["id"]] = t["content"].encode()
    ranks = {bytes(letters[c] for c in token): k for token, k in vocabulary.items() if token not in special}
    for piece, k in ranks.items():
        pieces[k] = piece
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True

    def by_tokenizers(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in slow.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    merged = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    first = 256
    in_order = all(vocabulary.get(a + b) == first + k for k, (a, b) in enumerate(merged))
    before = model.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not model.get("normalizer")
    if not (in_order and plain):
        return Coder(by_tokenizers, pieces, False)
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def by_ranks(texts: list[str]) -> list[list[int]]:
        # Its regular expressions overflow their stack on very long runs of white space.
        return [by_tokenizers([t])[0] if LONG_BLANK.search(t) else fast.encode_ordinary(" " + t) for t in texts]

    return Coder(by_ranks, pieces, True)


@lru_cache(8)
def piece_bpe(path: str) -> Coder:
    """A sentencepiece model, which puts a space before each text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for k in range(model.get_piece_size()):
        name = model.id_to_piece(k)
        pieces.append(bytes([int(name[3:5], 16)]) if model.is_byte(k) else name.replace("▁", " ").encode())
    by_word = not any(re.search("[^▁]▁", model.id_to_piece(k)) for k in range(model.get_piece_size()))
    return Coder(lambda texts: model.encode(texts, num_threads=1), pieces, by_word)


@dataclass
class Aligned:
    """Of tokens of both kinds over the same bytes: for each token its group, for each link its two tokens, by position."""

    closed: np.ndarray  # ends of the groups
    in_a: np.ndarray
    in_b: np.ndarray
    cuts: np.ndarray  # ends of the links
    own_a: np.ndarray
    own_b: np.ndarray


def align(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Aligned:
    """Groups and links of two cuts of the same bytes, given the sizes of their tokens."""
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # merges the two; union1d hashes them first
    cuts = both[np.diff(both, prepend=0) > 0]
    own_a, own_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    closed = cuts[(ends_a[own_a] == cuts) & (ends_b[own_b] == cuts)]
    return Aligned(closed, np.searchsorted(closed, ends_a), np.searchsorted(closed, ends_b), cuts, own_a, own_b)


def told(x: Aligned, ids_a: np.ndarray, ids_b: np.ndarray, first: Coder, second: Coder) -> tuple[list[str], np.ndarray]:
    """The tokens of the groups in order, a's then b's, each with what follows it, and the number of them up to each group's end."""
    upto_a, upto_b = (np.cumsum(np.bincount(g, minlength=len(x.closed))) for g in (x.in_a, x.in_b))
    k_a, k_b = np.arange(len(ids_a)), np.arange(len(ids_b))
    out = np.empty(len(ids_a) + len(ids_b), object)
    out[k_a + np.concatenate([[0], upto_b])[x.in_a]] = np.where(k_a + 1 == upto_a[x.in_a], first.bars[ids_a], first.inner[ids_a])
    out[k_b + upto_a[x.in_b]] = np.where(k_b + 1 == upto_b[x.in_b], second.ends[ids_b], second.inner[ids_b])
    return out.tolist(), upto_a + upto_b


def _joined(ids: list[int], coder: Coder) -> bytes:
    return b"".join(map(coder.pieces.__getitem__, ids))


def _packed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


@dataclass
class Pair:
    """The files of both tokenizers; loaded once in each worker."""

    byte_file: str
    piece_file: str

    def load(self) -> tuple[Coder, Coder]:
        return byte_bpe(self.byte_file), piece_bpe(self.piece_file)


def pair_of(folder: str) -> Pair:
    return Pair(f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model")


NUMBERS = ("n_a", "n_b", "n_groups", "n_products", "n_links")
#: Of a block: the pair of each link of each unit, the links of each unit, the unit at each place of the texts, the units of each text.
PACKED = ("at", "links", "codes", "units")


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of x up to each of the ends from the one before."""
    return np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])


def _encode_units(units: list[str], coder: Coder, together: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids in order, how many each unit has, and whether they give its bytes back; if not it has none.

    Units go to the tokenizer many at a time with a space between them, as they stood in the texts.
    """
    ids, sizes, good = [], [], []
    for at in range(0, len(units), together):
        some = units[at : at + together]
        own = np.array([len(t.encode()) + 1 for t in some])
        text = " ".join(some)
        found = coder.encode([text])[0] if coder.by_word else []
        ends, stops = np.cumsum(own), np.cumsum(coder.sizes[found])
        if _joined(found, coder) == b" " + text.encode() and (stops[np.searchsorted(stops, ends)] == ends).all():
            ids += found
            sizes.append(np.diff(np.searchsorted(stops, ends, "right"), prepend=0))
            good.append(np.ones(len(some), bool))
            continue
        each = coder.encode(some)
        right = [_joined(x, coder) == b" " + t.encode() for x, t in zip(each, some, strict=True)]
        ids += [y for x, ok in zip(each, right, strict=True) if ok for y in x]
        sizes.append(np.array([len(x) if ok else 0 for x, ok in zip(each, right, strict=True)]))
        good.append(np.array(right))
    none = np.empty(0, np.int64)
    return np.array(ids, np.int64), np.concatenate([none, *sizes]), np.concatenate([none.astype(bool), *good])


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of x up to each of the ends from the one before."""
    return np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])


def _block(texts: list[str | None], first: Coder, second: Coder) -> dict:
    """What a block of texts gives: arrays of one value a document, the block's id pairs, and packed the units of documents and the links of units."""
    units, n_units, by_word = [], [], first.by_word and second.by_word
    for t in texts:
        own = (BETWEEN.split(t) if by_word else [t]) if t else []
        units += own
        n_units.append(len(own))
    codes, names = pd.factorize(np.array([*units, None], object)[:-1])
    names, n_units = names.tolist(), np.array(n_units, np.int64)
    (a, n_a, good_a), (b, n_b, good_b) = (_encode_units(names, c) for c in (first, second))
    known = good_a & good_b
    a, b = a[np.repeat(known, n_a)], b[np.repeat(known, n_b)]
    good = _sums(~known[codes], np.cumsum(n_units)) == 0  # texts whose bytes both kinds of tokens give back
    codes, n_units = codes[np.repeat(good, n_units)], np.where(good, n_units, 0)

    x = align(first.sizes[a], second.sizes[b])
    last = np.cumsum(np.where(known, np.array([len(t.encode()) + 1 for t in names], np.int64), 0))
    upto_group, upto_link = np.searchsorted(x.closed, last, "right"), np.searchsorted(x.cuts, last, "right")
    product = np.bincount(x.in_a, minlength=len(x.closed)) * np.bincount(x.in_b, minlength=len(x.closed))
    n_links = np.diff(upto_link, prepend=0)
    of_unit = {"n_a": np.where(known, n_a, 0), "n_b": np.where(known, n_b, 0), "n_groups": np.diff(upto_group, prepend=0), "n_products": _sums(product, upto_group), "n_links": n_links}
    ends = np.cumsum(n_units)
    counts = {k: _sums(v[codes], ends) for k, v in of_unit.items()}

    tokens, upto_token = told(x, a, b, first, second)
    places = np.concatenate([[0], upto_token])[upto_group].tolist()
    parts = np.array(["".join(tokens[s:e]) for s, e in zip([0, *places], places)] + [None], object)[:-1]
    of_text = parts[codes].tolist()
    digests = [hashlib.sha256("".join(of_text[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip([0, *ends.tolist()], ends.tolist())]

    pairs, at = np.unique(a[x.own_a] << 32 | b[x.own_b], return_inverse=True)
    seen = np.repeat(np.bincount(codes, minlength=len(names)), n_links)
    linked = np.zeros(len(pairs), np.int64)
    np.add.at(linked, at, seen)
    packed = {k: _packed(v.astype(np.int32)) for k, v in (("at", at), ("links", n_links), ("codes", codes), ("units", n_units))}
    return counts | {"groups_sha256": digests, "pairs": pairs, "linked": linked} | packed


def encoded(docs: DataFrame, tokenizers: Pair, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each block of documents: arrays of their doc_id and numbers, the block's id pairs with how often each is linked, and what PACKED names."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrays = ", ".join(f"{k} array<long>" for k in NUMBERS)
    schema = f"block long, doc_id array<{kind}>, {arrays}, groups_sha256 array<string>, pairs array<long>, linked array<long>, {', '.join(f'{k} binary' for k in PACKED)}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, second = tokenizers.load()
        task, made = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def done() -> pa.RecordBatch:
            row = {"block": (task << 33) + made, "doc_id": pa.concat_arrays(ids).to_pylist()} | _block(texts, first, second)
            return pa.RecordBatch.from_pylist([row], schema=wanted)

        wanted = None
        for batch in batches:
            if wanted is None:
                longs = pa.list_(pa.int64())
                wanted = pa.schema(
                    [("block", pa.int64()), ("doc_id", pa.list_(batch.schema.field("doc_id").type)), *[(k, longs) for k in NUMBERS], ("groups_sha256", pa.list_(pa.string()))]
                    + [("pairs", longs), ("linked", longs), *[(k, pa.binary()) for k in PACKED]]
                )
            start = 0
            for k, text in enumerate(batch.column("text")):
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if held >= block_chars:
                    ids.append(batch.column("doc_id").slice(start, k + 1 - start))
                    yield done()
                    ids, texts, held, start, made = [], [], 0, k + 1, made + 1
            ids.append(batch.column("doc_id").slice(start))
        if texts:
            yield done()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (first id shifted by 32 bits, or second id), n: its links in the corpus, best: whether no pair with its second id has more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "linked")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.linked").alias("n"))
    counts = settled(each.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    second = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("second")
    most = settled(counts.groupBy(second).agg(F.max("n").alias("most")), "best-counts")
    return counts.withColumn("second", second).join(small(most), "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(blocks: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_products, n_links, n_best, count_sum, groups_sha256 of settled blocks.

    n_best: links whose pair is as frequent as any with its second id; count_sum: over links, the number of links of their pair.
    """
    counts = pair_counts(blocks)
    known = blocks.select("block", F.posexplode("pairs").alias("pos", "pair"))
    found = known.join(counts, "pair").select(F.col("block").alias("of"), "pos", "n", "best")
    numbers = [*NUMBERS, "n_best", "count_sum"]

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        at, links, codes, units = (_unpacked(row[k], np.int32) for k in PACKED)
        n, best = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
        n[right.pos], best[right.pos] = right.n, right.best
        out = {"doc_id": row.doc_id} | {k: row[k] for k in NUMBERS}
        out |= {k: _sums(_sums(of[at], np.cumsum(links))[codes], np.cumsum(units)) for k, of in (("n_best", best), ("count_sum", n))}
        return pd.DataFrame(out | {"groups_sha256": row.groups_sha256})

    held = blocks.select("block", "doc_id", *NUMBERS, "groups_sha256", *PACKED)
    kind = blocks.schema["doc_id"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{k} long' for k in numbers)}, groups_sha256 string"
    return held.groupBy("block").cogroup(found.groupBy("of")).applyInPandas(one, schema)


def alignment(docs: DataFrame, tokenizers: Pair, block_chars: int = BLOCK_CHARS) -> DataFrame:
    return aligned(settled(encoded(docs, tokenizers, block_chars), "encoded-blocks"))
