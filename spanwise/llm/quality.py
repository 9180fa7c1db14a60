"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Features of a text are shares of byte-class pairs (letters by case, digits,
spaces, line ends, punctuation marks, other), a few shape statistics (length, words'
length, repeated words, repeated lines) and a bias. From trusted positives
and unlabelled web text, both bounded samples:

1. a logistic model of positive against unlabelled is fitted;
2. the class prior is estimated by best-bin estimation: the least ratio, over
   score thresholds, of the unlabelled to the positive share above it (with a
   confidence margin); the unlabelled shares are counted over all documents
   outside the held-out fold;
3. a logistic model minimises the non-negative unbiased risk
   prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) by
   full-batch gradient steps (Kiryo et al. 2017); where the second part turns
   negative its gradient is reversed;
4. the offset is set so that the share of those documents scored at the operating
   threshold or more equals the prior, by a histogram over all of them.

Labels of value 0 are never read. Null and empty texts have the features of an
empty text. Without positives every score is 0.5. Repeated rows are scored
each, and count once in the samples; extra columns are ignored; an empty table
gives no rows. A very long text is taken alone, in pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .shared import held_out, labelled_sample, small_batches, stage_table, unstage

#: Positives and unlabelled rows that training takes at most (in hash order of doc_id).
POSITIVES, UNLABELLED = 4_000, 8_000
#: Scores from here on count as good. Cells of the histogram that the offset is read from.
THRESHOLD, CELLS = 0.3, 1 << 16
#: Byte classes: lower case, upper case, digit, space, line end, above ASCII, control; then each punctuation mark below.
MARKS = ".,!?|#$%&*:;-'\""
CLASSES = 8 + len(MARKS)
SHAPES = 6
WIDTH = CLASSES * CLASSES + SHAPES + 1


def class_table() -> np.ndarray:
    t = np.full(256, 7, np.int64)
    t[0x61:0x7B], t[0x41:0x5B], t[0x30:0x3A], t[0x20], t[0x0A], t[0x80:], t[:0x09] = 0, 1, 2, 3, 4, 5, 6
    for i, c in enumerate(MARKS):
        t[ord(c)] = 8 + i
    return t


def _repeats(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Share of spans in each row that repeat another of the row."""
    n = len(first) - 1
    rows = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((hashes, rows))
    same = (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    again = np.bincount(rows[order][1:][same], minlength=n)
    return again / np.maximum(np.diff(first), 1)


def features(column: pa.Array) -> np.ndarray:
    """(rows, WIDTH) float32 features."""
    out = np.zeros((len(column), WIDTH), np.float32)
    kinds, alnum = class_table(), bt.alnum_table()
    line = np.ones(256, bool)
    line[0x0A] = False
    for lo, n, buf, offs in bt.blocks(column):
        size, counts = np.diff(offs), np.zeros(n * CLASSES**2, np.int64)
        for a in range(0, len(buf) - 1, bt.BLOCK_BYTES):  # a very long text goes by pieces, each with the first byte of the next
            piece = buf[a : a + bt.BLOCK_BYTES + 1]
            rows = np.repeat(np.arange(n), np.diff(np.clip(offs, a, a + len(piece))))
            c = kinds[piece]
            pair = rows[1:] == rows[:-1]
            counts += np.bincount((rows[1:] * CLASSES**2 + c[:-1] * CLASSES + c[1:])[pair], minlength=n * CLASSES**2)
        counts = counts.reshape(n, -1)
        out[lo : lo + n, : CLASSES**2] = np.sqrt(counts / np.maximum(size - 1, 1)[:, None])
        starts, ends, first = bt.word_bounds(buf, offs, alnum)
        lines, line_ends, first_line = bt.word_bounds(buf, offs, line)
        words = np.diff(first)
        mean = (np.concatenate(([0], np.cumsum(ends - starts)))[first[1:]] - np.concatenate(([0], np.cumsum(ends - starts)))[first[:-1]]) / np.maximum(words, 1)
        shapes = [np.log1p(size) / 8, np.log1p(words) / 6, mean / 8, _repeats(bt.word_hashes(buf, starts, ends), first), _repeats(bt.word_hashes(buf, lines, line_ends), first_line), np.log1p(np.diff(first_line)) / 4]
        out[lo : lo + n, CLASSES**2 : CLASSES**2 + SHAPES] = np.stack(shapes, axis=1)
    out[:, -1] = 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def minimise(gradient, width: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam over a full-batch gradient, from zero."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def prior_cuts(positive: np.ndarray) -> np.ndarray:
    """Score thresholds at which the class prior is looked for."""
    return np.quantile(positive, np.linspace(0.02, 0.98, 97))


def class_prior(positive: np.ndarray, shares: np.ndarray, n: int) -> float:
    """Best-bin estimate of the share of positives among unlabelled, from scores of positives and the share of ``n`` unlabelled at each of prior_cuts()."""
    p = (positive[None, :] >= prior_cuts(positive)[:, None]).mean(axis=1)
    margin = np.sqrt(np.log(20) / 2 / max(1, n)) + np.sqrt(np.log(20) / 2 / len(positive))
    best = np.argmin((shares + margin) / p)
    return float(np.clip(shares[best] / p[best], 0.01, 0.99))


def fit_plain(positive: np.ndarray, unlabelled: np.ndarray, l2: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights of positive against unlabelled on two thirds of the samples, and the scores of the positives left over."""
    keep = np.arange(len(positive)) % 3 > 0, np.arange(len(unlabelled)) % 3 > 0
    x, y = np.concatenate([positive[keep[0]], unlabelled[keep[1]]]), np.concatenate([np.ones(keep[0].sum()), np.zeros(keep[1].sum())])
    side = np.where(y > 0, 1 / max(1, keep[0].sum()), 1 / max(1, keep[1].sum()))
    w = minimise(lambda w: x.T @ ((sigmoid(x @ w) - y) * side) + l2 * w, x.shape[1], steps)
    return w, positive[~keep[0]] @ w


def risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk: of positives as positive, and of the rest as negative (which is cut off at 0)."""
    loss = lambda x: np.log1p(np.exp(np.clip(x, -35, 35))).mean()
    return prior * loss(-positive @ w), loss(unlabelled @ w) - prior * loss(positive @ w)


def risk_gradient(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of both parts of risk()."""
    sp, su = sigmoid(positive @ w), sigmoid(unlabelled @ w)
    return positive.T @ (sp - 1) / len(positive) * prior, unlabelled.T @ su / len(unlabelled) - positive.T @ sp / len(positive) * prior


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, l2: float = 1e-4, steps: int = 600) -> np.ndarray:
    """Weights by non-negative PU risk."""

    def gradient(w):
        plus, minus = risk_gradient(w, positive, unlabelled, prior)
        return (plus + minus if risk(w, positive, unlabelled, prior)[1] >= 0 else -minus) + l2 * w

    return minimise(gradient, positive.shape[1], steps)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    prior: float


def training_sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, kind, f): features of trusted positives (1) and of any documents (0) outside the held-out fold, bounded numbers of each, staged."""
    trusted = labelled_sample(labels.where(F.col(label) == 1), label, POSITIVES).select("doc_id", F.lit(1).alias("kind"))
    ready = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    any_ = ready.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(UNLABELLED).select("doc_id", F.lit(0).alias("kind"))

    def featurise(batches):
        for b in batches:
            f = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("kind"), pa.array(list(f), pa.list_(pa.float32()))], ["doc_id", "kind", "f"])

    def bounded_part(ids: DataFrame, most: int) -> DataFrame:
        # An id may stand on any number of rows.
        rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInArrow(featurise, "doc_id long, kind int, f array<float>").distinct()
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("f")).limit(most)

    return stage_table(bounded_part(trusted, POSITIVES).unionByName(bounded_part(any_, UNLABELLED)), "training")


def in_one_task(sample: DataFrame, run, schema: str) -> list:
    """Rows that ``run(positive, unlabelled)`` gives in a task that holds the whole sample; none where it lacks either kind."""

    def task(batches):
        parts = [(b.column("kind").to_numpy(), b.column("f").flatten().to_numpy().reshape(-1, WIDTH)) for b in batches if b.num_rows]
        kinds, f = (np.concatenate([p[i] for p in parts]) if parts else np.empty((0, WIDTH)) for i in (0, 1))
        if len(f) and (kinds == 1).any() and (kinds == 0).any():
            yield run(f[kinds == 1].astype(np.float64), f[kinds == 0].astype(np.float64))

    return sample.repartition(1).sortWithinPartitions("kind", F.xxhash64("doc_id"), "doc_id", F.xxhash64("f")).mapInArrow(task, schema).collect()


def counts_above(docs: DataFrame, w: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many documents score each of the ascending ``cuts`` or more, and, first, how many there are."""
    shipped = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), cuts))

    def count(batches):
        weights, bounds = shipped.value
        total = np.zeros(len(bounds) + 1, np.int64)
        for b in batches:
            total += np.bincount(np.searchsorted(bounds, (features(b.column("text")) @ weights).astype(np.float64), side="right"), minlength=len(bounds) + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    found = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most one row a cut
    cells = np.zeros(len(cuts) + 1, np.int64)
    for r in found:
        cells[r.cell] = r.n
    return cells[::-1].cumsum()[::-1]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    """Train on bounded samples outside the held-out fold; the prior and the offset are taken over all documents outside of it."""
    small_batches(docs.sparkSession)
    sample = training_sample(docs, labels, label)
    ready = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = lambda *xs: pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.float64())) for x in xs], ["w", "scores"][: len(xs)])
    plain = in_one_task(sample, lambda p, u: one(*fit_plain(p, u)), "w array<double>, scores array<double>")
    if not plain or not plain[0].scores:
        return QualityModel(np.zeros(WIDTH), 0.5)
    scores = np.array(plain[0].scores)
    above = counts_above(ready, np.array(plain[0].w), prior_cuts(scores))
    prior = class_prior(scores, above[1:] / max(1, above[0]), int(above[0]))
    w = np.array(in_one_task(sample, lambda p, u: one(fit_pu(p, u, prior)), "w array<double>")[0].w)
    unstage(sample)
    cuts = np.linspace(-35, 35, CELLS)
    above = counts_above(ready, w, cuts)
    w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - cuts[np.flatnonzero(above[1:] >= prior * above[0]).max(initial=0)]
    return QualityModel(w, prior)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        w = model.value.weights.astype(np.float32)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sigmoid((features(b.column("text")) @ w).astype(np.float64)))], ["doc_id", "score"])

    out = docs.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
