"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, its pairs of adjacent
words, its pairs with one word between, and the stems (first bytes) of its
longer words, so that an inflected insult counts too; all in 2**bits places. Training runs
McMahan et al.'s FTRL-proximal (per-coordinate rates, L1 sparsity) over a
bounded, documented sample of labelled rows; what comes out is a short list of
non-zero weights, small enough to ship to every task whatever the corpus.

Null and empty texts have no features and get the score of the bias alone.
Repeated rows are scored each; conflicting labels are examples each, repeated
ones count once, and so do equal rows. With no labelled row at all, every score is
0.5. An empty table gives no rows. A very long text is taken alone, in arrays of its
words' hashes. Extra columns are ignored, or pass where documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from .shared import held_out, labelled_sample, small_batches

#: Labelled rows that training takes at most (in hash order of doc_id).
TRAIN_ROWS = 12_000
BITS = 20
#: Word places of each kind of feature: words, adjacent pairs, pairs that skip one word.
GRAMS = ((0,), (0, 1), (0, 2))
#: Bytes of a word's stem; only longer words have one.
STEMS = (4, 5)


@dataclass(frozen=True)
class FtrlModel:
    """Sparse weights by feature place; ``bias`` alone is the score of an empty text. ``examples``: how many were learned from."""

    bits: int
    places: np.ndarray
    weights: np.ndarray
    bias: float
    examples: int

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.places] = self.weights
        return w


def features(column: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, feature places, row of each) for runs of rows; places may repeat within a row."""
    table, shift = bt.alnum_table(), np.uint64(64 - bits)
    for lo, n, buf, offs in bt.blocks(column):
        starts, ends, first = bt.word_bounds(buf, offs, table)
        words, owner = bt.word_hashes(buf, starts, ends), np.repeat(np.arange(n), np.diff(first))
        found = [bt.gram_hashes(words, first, steps) for steps in GRAMS]
        for k in STEMS:
            long = np.flatnonzero(ends - starts > k)
            found.append((bt.mix(bt.word_hashes(buf, starts[long], starts[long] + k)), owner[long]))
        yield lo, n, np.concatenate([h >> shift for h, _ in found]).astype(np.int64), np.concatenate([r for _, r in found])


def ftrl(examples: list[np.ndarray], labels: np.ndarray, bits: int, alpha: float = 0.15, beta: float = 1.0, l1: float = 6.0, l2: float = 0.5, epochs: int = 3) -> tuple[np.ndarray, float]:
    """FTRL-proximal over sparse 0/1 examples in the given order: weights and bias."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias, drift = 0.0, 1.0
    for _ in range(epochs):
        for x, y in zip(examples, labels, strict=True):
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) > l1, -(zx - np.sign(zx) * l1) / ((beta + root) / alpha + l2), 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            after = np.sqrt(nx + g * g)
            z[x] = zx + g - (after - root) / alpha * w
            n[x] = nx + g * g
            drift += g * g
            bias -= alpha * g / np.sqrt(drift)
    root = np.sqrt(n)
    return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + root) / alpha + l2), 0.0), bias


def fit(texts: DataFrame, bits: int = BITS, rows: int = TRAIN_ROWS) -> FtrlModel:
    """Train on (doc_id, text, label) rows, equal ones once, and at most ``rows`` of them (in hash order of doc_id): one task holds their features."""

    def featurise(batches):
        for b in batches:
            places, rows, base = [], [], 0
            for lo, n, idx, row in features(b.column("text"), bits):
                pairs = np.unique((row + lo).astype(np.int64) << bits | idx)
                places.append(pairs & ((1 << bits) - 1))
                rows.append(pairs >> bits)
            got = bt.as_list(np.concatenate(places or [np.empty(0, np.int64)]), np.concatenate(rows or [np.empty(0, np.int64)]), b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), got], ["doc_id", "label", "places"])

    def train(batches):
        examples, labels = [], []
        for b in batches:
            col = b.column("places")
            flat, offs = col.flatten().to_numpy(zero_copy_only=False), np.asarray(col.offsets)
            offs = offs - offs[0]
            examples += [flat[offs[i] : offs[i + 1]] for i in range(len(offs) - 1)]
            labels.append(b.column("label").to_numpy(zero_copy_only=False))
        if not examples:
            return
        w, bias = ftrl(examples, np.concatenate(labels).astype(float), bits)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([w[at].tolist()], pa.list_(pa.float64())), pa.array([float(bias)]), pa.array([len(examples)], pa.int64())], ["places", "weights", "bias", "examples"])

    one = texts.select(F.col("doc_id").cast("long"), "text", F.col("label").cast("int")).mapInArrow(featurise, "doc_id long, label int, places array<int>")
    # An id may stand on any number of rows, so the join with a bounded sample of ids bounds nothing.
    if texts.select("doc_id", "label").groupBy("doc_id", "label").count().where("count > 1").limit(1).count():
        one = one.distinct()
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.size("places"), F.xxhash64("places")).limit(rows)
    found = one.mapInArrow(train, "places array<int>, weights array<double>, bias double, examples long").collect()
    if not found:
        return FtrlModel(bits, np.empty(0, np.int64), np.empty(0), 0.0, 0)
    return FtrlModel(bits, np.array(found[0].places, np.int64), np.array(found[0].weights), found[0].bias, found[0].examples)


def fit_labelled(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> FtrlModel:
    """Train on a bounded sample of ``labels`` joined with their texts; rows of the held-out fold take no part."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(labels, label, rows)
    return fit(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), rows=rows)


def score(docs: DataFrame, model: FtrlModel, out: str = "score") -> DataFrame:
    """``docs`` with the column ``out`` (double, 0 to 1), a name that they don't have; other columns pass through unread."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    names = docs.columns
    text_at = names.index("text")
    schema = docs.select("*").schema.add(out, "double")

    def run(batches):
        m = shipped.value
        w = m.dense()
        for b in batches:
            total = np.zeros(b.num_rows)
            for lo, n, idx, row in features(b.column(text_at), m.bits):
                hit = np.flatnonzero(w[idx])
                pairs = np.unique(row[hit] << m.bits | idx[hit])
                total[lo : lo + n] += np.bincount(pairs >> m.bits, weights=w[pairs & ((1 << m.bits) - 1)], minlength=n)
            p = 1 / (1 + np.exp(-np.clip(total + m.bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*names, out])

    return docs.mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = fit_labelled(docs, labels)
    scored = score(docs.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
