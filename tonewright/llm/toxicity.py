"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over the words of the whole text, trained with numpy from two bounded samples:
confirmed toxic documents (at most MOST_TOXIC) and unlabelled text (at most MOST_UNLABELLED), both
the first of the training fold by a hash of their id, and at most MOST_WORDS distinct words of each. The risk is that of Kiryo et al. (2017): with
class prior p, p times the loss of the toxic sample as positive, plus the loss of the unlabelled
sample as negative less p times that of the toxic sample as negative; when that difference falls
below zero, its gradient is followed upwards, so the classifier can't fit the toxic rows hidden in
the unlabelled text. The prior is counted over all labels of the training fold.

One task trains on the samples' word hashes and only the weights reach the driver; scoring is a pass over all whole texts. Words are
lower-cased and lose punctuation at their ends; a word counts once a document. Null and empty texts
have no words and get the score of the constant term. Duplicate labels of a document: toxic if any
is. A null label is none, and a document without an id trains nothing. Without a toxic label in the
training fold every score is 0. Long texts are scored whole. Repeated rows score alike, as do ties; an
empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.llm.storage import settled

MOST_TOXIC = 4000
MOST_UNLABELLED = 12000
MOST_WORDS = 4_000_000
LEAST_DOCS = 4
FOLDS = 5
EDGES = ".,;:!?\"'()[]{}<>|*$%&#-_"


def word_ids(text: str | None) -> list[int]:
    """Hashes of the distinct words."""
    return list({crc32(w.encode("utf-8", "surrogatepass")) for x in set((text or "").lower().split()) if (w := x.strip(EDGES))})


class Rows:
    """Documents as sets of columns."""

    def __init__(self, docs: list[np.ndarray], columns: np.ndarray):
        at = [np.searchsorted(columns, d) for d in docs]
        own = [a[(a < len(columns)) & (columns[np.minimum(a, len(columns) - 1)] == d)] if len(columns) else a[:0] for a, d in zip(at, docs, strict=True)]
        self.n, self.width = len(docs), len(columns)
        self.cols = np.concatenate(own) if own else np.zeros(0, np.int64)
        self.rows = np.repeat(np.arange(self.n), [len(x) for x in own])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows], self.width)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float, beta: float = 0.0, gamma: float = 0.5) -> tuple[float, np.ndarray, np.ndarray]:
    """The part of the risk for negatives, and the step's gradient by the scores of toxic and unlabelled rows."""
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    gp_neg, gu_neg = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
    if negative < -beta:
        return negative, -gamma * gp_neg, -gamma * gu_neg
    return negative, gp_neg - prior * sigmoid(-zp) / len(zp), gu_neg


def fit(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.05, l1: float | None = None, beta: float = 0.0, gamma: float = 0.5) -> tuple[dict[int, float], float]:
    """Weights by word hash, and the constant, that minimise the non-negative risk with the logistic loss.

    l1 shrinks weights; by default in inverse proportion to the toxic sample, so that a few rows' chance words get none.
    """
    l1 = min(1e-3, 0.06 / max(1, len(toxic))) if l1 is None else l1
    ids, n = np.unique(np.concatenate([np.unique(d) for d in [*toxic, *unlabelled]] or [np.zeros(0, np.int64)]), return_counts=True)
    columns = ids[n >= LEAST_DOCS]
    p, u = Rows(toxic, columns), Rows(unlabelled, columns)
    w, b = np.zeros(len(columns)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        zp, zu = p.dot(w) + b, u.dot(w) + b
        _, gp, gu = risk(zp, zu, prior, beta, gamma)
        g, gb = p.back(gp) + u.back(gu), gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.999**t
        scale = rate / (np.sqrt(v / fix2) + 1e-4)
        w = w - scale * m / fix
        w = np.sign(w) * np.maximum(np.abs(w) - scale * l1, 0)
        b -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-4)
    keep = w != 0
    return dict(zip(columns[keep].tolist(), w[keep].tolist(), strict=True)), b


def in_fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo folds; 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_unlabelled: int = MOST_UNLABELLED, most_words: int = MOST_WORDS) -> tuple[dict[int, float], float]:
    """Weights and constant; no weight and -inf if no label of the training fold is toxic.

    Of each sample the documents are used, by the hash, that fit into most_words distinct words in all: one that doesn't fit is left out, those behind it
    still count. An id is sampled once, however many rows it has.
    """
    known = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .filter(in_fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    if not toxic:
        return {}, float("-inf")
    by_hash = F.xxhash64(F.lit("sample"), "doc_id")
    chosen = known.filter("toxic = 1").orderBy(by_hash, "doc_id").limit(most_toxic).select("doc_id").withColumn("kind", F.lit(1))
    # Text without regard to labels; toxic rows among it are what the risk is made for.
    rest = docs.filter("doc_id IS NOT NULL").filter(in_fold(F.col("doc_id")) != 0).select("doc_id").distinct()
    rest = rest.orderBy(by_hash.desc(), "doc_id").limit(most_unlabelled).withColumn("kind", F.lit(0))
    ids = sorted({(r.doc_id, r.kind) for r in chosen.unionByName(rest).collect() if r.doc_id is not None})
    pick = F.broadcast(docs.sparkSession.createDataFrame(ids, f"doc_id {dict(docs.dtypes)['doc_id']}, kind int"))  # as many rows as the bounds

    sample = docs.join(pick, "doc_id").groupBy("doc_id", "kind").agg(F.min("text").alias("text"))
    prior = min(max(toxic / n, 1e-3), 0.9)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((k, i, ids) for batch in batches for k, i, ids in zip(*[batch.column(c).to_pylist() for c in range(2)], [np.sort(x.values.to_numpy()) for x in batch.column(2)], strict=True)), key=lambda r: r[:2])
        weights, constant = fit([x for k, _, x in rows if k == 1], [x for k, _, x in rows if k == 0], prior)
        columns = [pa.array([None, *weights], pa.int64()), pa.array([constant, *weights.values()], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "weight"])

    hashed = sample.select("kind", "doc_id", F.pandas_udf(lambda s: pd.Series([word_ids(t) for t in s], dtype=object), "array<long>")("text").alias("ids"))
    hashed = settled(hashed, "sample")
    sizes = hashed.select("kind", "doc_id", F.size("ids").alias("n"), F.xxhash64(F.lit("order"), "doc_id").alias("h")).collect()  # as many rows as the bounds
    kept, words = [], [0, 0]
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if words[r.kind] + r.n <= most_words:
            words[r.kind] += r.n
            kept.append((r.doc_id, r.kind))
    used = hashed.select("kind", "doc_id", "ids")
    if len(kept) < len(sizes):
        used = used.join(F.broadcast(docs.sparkSession.createDataFrame(kept, f"doc_id {dict(docs.dtypes)['doc_id']}, kind int")), ["kind", "doc_id"])
    found = used.repartition(1).mapInArrow(learn, "id long, weight double").collect()  # one task for the bounded sample
    return {r.id: r.weight for r in found if r.id is not None}, next((r.weight for r in found if r.id is None), float("-inf"))


def score(docs: DataFrame, model: tuple[dict[int, float], float]) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    weights = docs.sparkSession.sparkContext.broadcast(model)  # at most as many words as the samples have

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, b = weights.value
        for texts in batches:
            z = np.array([b + sum(w.get(x, 0.0) for x in (word_ids(t) if w else ())) for t in texts], dtype=float)
            yield pd.Series(np.where(np.isneginf(z), 0.0, sigmoid(np.maximum(z, -700))))

    return docs.select("doc_id", scored("text").alias("score"))
