"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: the sets of its words, word pairs and pairs with one word between, hashed to 2**18 coordinates.
Training: labelled rows are featurised on the executors; the first of them, by the hash of id and text, are the sample: at most `rows`
labels, and no more than together have `size` bytes of features (a longer text than all that is left is passed over). The driver
fits FTRL-proximal on them with per-coordinate rates, L1 and L2 in `epochs` passes. L1 leaves few weights; these, at most
2**18 floats whatever the input, are what each task gets. Scoring reads each text once, whole, without a shuffle.

Defined results: a null or empty text scores the intercept; null labels and labels of unknown documents are not learned
from; without usable labels every score is 0.1; of several labels of one document each counts; repeated rows each get
their row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_table, stash, table
from .textnum import Words, blocks, mix, sum_by, texts

BITS = 18
ROWS, SIZE = 12_000, 32 << 20  # bounds of the sample: labels, and bytes of their texts' features
SCHEMA = "doc_id long, score double"


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and their texts: words, pairs, pairs with one word between; with repetitions."""
    h, owner = words.hashes, words.owners()
    out, own = [h], [owner]
    for gap, salt in ((1, 0x51ED270B), (2, 0xA5CB9243)):
        if len(h) > gap:
            same = owner[gap:] == owner[:-gap]
            out.append(mix(h[:-gap] * np.uint64(3) + h[gap:] + np.uint64(salt))[same])
            own.append(owner[gap:][same])
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(own)


def once(coordinates: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each coordinate once a text."""
    both = np.unique((owner.astype(np.int64) << BITS) | coordinates)
    return (both & ((1 << BITS) - 1)).astype(np.int32), both >> BITS


def featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts(batch.column(2))
        sets = []
        for i, j in blocks(offsets):
            at, owner = once(*features(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
            cut = np.searchsorted(owner, np.arange(j - i + 1))
            sets += [at[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.binary())], names=["place", "toxic", "size", "at"])


def ftrl(rows: list[tuple[np.ndarray, int]], alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0, epochs: int = 4, positive: float = 2.0) -> np.ndarray:
    """Weights; the last is the intercept, which has no L1. positive: what a toxic row weighs, as they are few."""
    n_at = 1 << BITS
    z, n, weights = np.zeros(n_at + 1), np.zeros(n_at + 1), np.zeros(n_at + 1)
    z0 = n0 = 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, y = rows[k]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            w0 = -z0 / ((beta + n0**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35)))
            g = (p - y) * (positive if y else 1.0)
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            z0, n0 = z0 + g - ((n0 + g * g) ** 0.5 - n0**0.5) / alpha * w0, n0 + g * g
    live = np.abs(z[:-1]) > l1
    weights[:-1][live] = (-(z[:-1] - np.sign(z[:-1]) * l1) / ((beta + np.sqrt(n[:-1])) / alpha + l2))[live]
    weights[-1] = -z0 / ((beta + n0**0.5) / alpha)
    return weights


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> np.ndarray:
    """Weights from a bounded sample of the given labels (doc_id, toxic); hold rows out before."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    sample = F.broadcast(usable.orderBy(F.xxhash64("_id"), "_id", "toxic").limit(rows))  # at most `rows` rows of two numbers
    texts_ = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(sample, "_id")
    # an id may have many rows: of them all, the first `rows` by place
    found = stash(map_arrow(texts_.select(F.xxhash64("_id", "_text").alias("place"), "toxic", "_text"), featurised, "place long, toxic int, size long, at binary"), "features")
    kept, left = [], size
    for r in found.select("place", "toxic", "size").orderBy("place", "toxic", "size").limit(rows).collect():  # three numbers a row
        if r["size"] <= left:
            left -= r["size"]
            kept.append((r["place"], r["toxic"]))
    if not kept:
        out = np.zeros((1 << BITS) + 1)
        out[-1] = np.log(0.1 / 0.9)
        return out
    copies = Counter(kept)
    chosen = small_table(docs.sparkSession, place=pa.array([p for p, _ in copies], pa.int64()), toxic=pa.array([t for _, t in copies], pa.int32()), copies=pa.array(copies.values(), pa.int32()))
    distinct = found.join(F.broadcast(chosen), ["place", "toxic"]).groupBy("place", "toxic", "copies").agg(F.first("at").alias("at")).collect()  # `size` bytes at most
    chosen_rows = [(np.frombuffer(r["at"], np.int32), r["toxic"]) for r in sorted(distinct, key=lambda r: (r["place"], r["toxic"])) for _ in range(r["copies"])]
    return ftrl(chosen_rows)


class Scorer:
    """Scores of texts under the live weights."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, intercept: float):
        self.weights, self.intercept = np.zeros(1 << BITS), intercept
        self.weights[at] = weight
        self.live = self.weights != 0

    def __call__(self, column: pa.Array) -> np.ndarray:
        data, offsets = texts(column)
        out = np.empty(len(column))
        for i, j in blocks(offsets):
            c, owner = features(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            keep = self.live[c]
            c, owner = once(c[keep], owner[keep])
            out[i:j] = sum_by(self.weights[c], owner, j - i)
        return 1 / (1 + np.exp(-np.clip(out + self.intercept, -35, 35)))


def live(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    at = np.flatnonzero(weights[:-1])
    return at, weights[:-1][at], float(weights[-1])


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    model = live(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scorer(batch.column(1)))], names=["doc_id", "score"])

    return map_arrow(docs.select(id_col, text_col), scored, SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = ROWS, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic; each row is judged by its own text, in place."""
    model = live(train(docs, labels.filter(~held_out(F.col("doc_id"))), rows, text_col=text_col))
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(at)) < 0.5))

    return map_arrow(docs, clean, docs.schema)


def held_out(col):
    return F.crc32(col.cast("string")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Labels of held-out documents are not learned from; a null id is not held out."""
    weights = train(docs, labels.filter(~held_out(F.col("doc_id"))), rows)
    return score(docs, weights).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
