"""Mixing sources to target weights with soft domain membership.

A multinomial naive Bayes classifier over hashed words, trained on a bounded
sample of a labelled table, gives each document a posterior over domains. The
rates r >= 0 (expected copies of each document) then minimise

    sum_k ((sum_d r_d tokens_d p_dk) - target_k)^2 / (2 m_k),   m_k = sum_d tokens_d p_dk

by projected gradient from r = 1, in the metric weighted by tokens: one step is
r_d <- max(r_d - p_d . g, low). The plain g is residual_k / m_k; it is scaled by the
inverse of G = sum_d tokens_d p_d p_d' over the documents that are free to move
(those above ``low``, or drawn up from it), which makes a step exact but for rates that it
clips, so that a few passes do. A pass tries the step, its half and quarter, and the plain
one, and takes the first that makes the sum smaller; others leave no trace, so rates never end
worse than they were. Passes go on until the totals match, or until the sum no longer
falls: rates of low or more can't reach some targets, nor can domains that no word
tells apart be moved against each other, and the log then says what
was missed. All documents' rates follow from the same short list of K-vectors, so a
pass over the corpus adds up K + K * K numbers for each step tried and nothing else leaves the
executors; the rates are replayed wherever they are needed.

Null and empty texts have no tokens and the prior as posterior; their rate is 1.
With an empty labelled table all documents belong to the one domain ''. An empty
table gives no rows. Repeated rows are documents each, with the same rate, and
are rounded to copies alike. A very long text is taken alone, its words in pieces.
Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .shared import fresh, labelled_sample, small_batches, stage_table

#: Labelled rows that training takes at most; places of hashed words; domains that are told apart at most (more raise).
TRAIN_ROWS, BITS, DOMAINS = 8_000, 15, 1_000
#: Log-likelihoods are averaged over words and counted as of so many words at most: memberships stay soft.
SHARPNESS = 12.0
#: The fit has stalled when the sum fell by less than this share over so many steps (each stands for up to four passes of one trial).
STALL, STALL_GAIN = 4, 5e-3
#: Parts of the scaled step that a pass tries, in this order, before the plain one.
PARTS = (1.0, 0.5, 0.25)
#: Log-probabilities of words (one for each domain) that are held at once.
PIECE = 1 << 20
LOG = logging.getLogger(__name__)


@dataclass
class Mixture:
    """Domain names, log-probabilities of words (place, domain), log-priors; fitted steps and rate bounds."""

    domains: list[str]
    words: np.ndarray
    prior: np.ndarray
    low: float = 0.0
    high: float = np.inf
    steps: list[np.ndarray] = field(default_factory=list)

    def posterior(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, posterior by domain) of each row."""
        table, shift = bt.alnum_table(), np.uint64(64 - BITS)
        tokens, out = np.zeros(len(column)), np.tile(self.prior, (len(column), 1))
        for lo, n, buf, offs in bt.blocks(column):
            starts, ends, first = bt.word_bounds(buf, offs, table)
            at = (bt.word_hashes(buf, starts, ends) >> shift).astype(np.int64)
            counts = np.diff(first)
            total, size = np.zeros((n, len(self.domains))), max(1, PIECE // len(self.domains))
            for a in range(0, len(at), size):
                sums = np.zeros((min(size, len(at) - a) + 1, len(self.domains)))
                np.cumsum(self.words[at[a : a + size]], axis=0, out=sums[1:])
                i, j = np.searchsorted(first, a, side="right") - 1, np.searchsorted(first, a + len(sums) - 1)
                bounds = np.clip(first[i : j + 1] - a, 0, len(sums) - 1)
                total[i:j] += sums[bounds[1:]] - sums[bounds[:-1]]
            tokens[lo : lo + n] = counts
            out[lo : lo + n] += total * (np.minimum(counts, SHARPNESS) / np.maximum(counts, 1))[:, None]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return tokens, out / out.sum(axis=1, keepdims=True)

    def rates(self, tokens: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        r = np.ones(len(posterior))
        for g in self.steps:
            r = np.clip(r - posterior @ g, self.low, self.high)
        return np.where(tokens > 0, r, 1.0)


def classifier(docs: DataFrame, labels: DataFrame, domain: str = "domain", rows: int = TRAIN_ROWS) -> Mixture:
    """Train on a bounded sample of ``labels`` (doc_id, domain) outside the held-out fold."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(labels, domain, rows)
    shift = np.uint64(64 - BITS)

    def count(batches):
        table = bt.alnum_table()
        for b in batches:
            names, own = np.unique(np.array(b.column("label").to_pylist(), dtype=str), return_inverse=True)
            total = np.zeros((len(names), 1 << BITS), np.int64)
            for lo, n, buf, offs in bt.blocks(b.column("text")):
                starts, ends, first = bt.word_bounds(buf, offs, table)
                at = (bt.word_hashes(buf, starts, ends) >> shift).astype(np.int64)
                np.add.at(total, (np.repeat(own[lo : lo + n], np.diff(first)), at), 1)
            k, at = np.nonzero(total)
            docs_of = np.bincount(own, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names[k].tolist() + names.tolist(), pa.string()), pa.array(np.concatenate([at, np.full(len(names), -1)]), pa.int64()), pa.array(np.concatenate([total[k, at], docs_of]), pa.int64())], ["label", "place", "n"])

    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", F.col("label").cast("string").alias("label"))), "doc_id")
    counts = texts.select("text", "label").mapInArrow(count, "label string, place long, n long").groupBy("label", "place").agg(F.sum("n").alias("n"))
    kinds = sample.select("label").distinct().count()
    if kinds > DOMAINS:
        raise ValueError(f"{kinds} domains; at most {DOMAINS} can be mixed at once")
    got = counts.toArrow().to_pydict()  # at most 2**BITS + 1 rows for each domain of the sample
    domains = sorted(set(got["label"])) or [""]
    index = {k: i for i, k in enumerate(domains)}
    words, seen = np.zeros((1 << BITS, len(domains))), np.ones(len(domains))
    for label, place, n in zip(got["label"], got["place"], got["n"], strict=True):
        if place < 0:
            seen[index[label]] += n
        else:
            words[place, index[label]] += n
    words = (words + 0.1) / (words + 0.1).sum(axis=0)
    return Mixture(domains, np.log(words), np.log(seen / seen.sum()))


def fit_rates(docs: DataFrame, model: Mixture, targets, low: float = 0.0, high: float = np.inf, close: float = 1e-4) -> tuple[Mixture, list[dict]]:
    """Fit the steps to ``targets``: token totals by domain, or a function of the observed totals that gives them.

    ``high`` bounds the rates if given. Returns the model and the totals at the start and after each step.
    """
    model.low, model.high, model.steps = low, high, []
    small_batches(docs.sparkSession)
    spark, kinds = docs.sparkSession, len(model.domains)
    shipped = spark.sparkContext.broadcast(model)

    def members(batches):
        for b in batches:
            tokens, p = shipped.value.posterior(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), kinds).cast(pa.list_(pa.float64()))], ["tokens", "p"])

    table = stage_table(docs.select("text").mapInArrow(members, "tokens double, p array<double>"), "members")

    def totals(steps, tries, draw) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of ``tries`` after ``steps``: expected tokens by domain, and the Gram matrix of the documents that are free to move along ``draw``."""
        base, n = Mixture([], np.empty((0, kinds)), np.empty(0), low, high, steps), kinds * (kinds + 1)

        def add(batches):
            out = np.zeros((len(tries), n))
            for b in batches:
                tokens = b.column("tokens").to_numpy()
                p = b.column("p").flatten().to_numpy().reshape(-1, kinds)
                start, along = base.rates(tokens, p), p @ draw
                for k, g in enumerate(tries):
                    rates = np.where(tokens > 0, np.clip(start - p @ g, low, high), 1.0)
                    free = (rates > low) & (rates < high) | (rates <= low) & (along > 0) | (rates >= high) & (along < 0)
                    out[k, :kinds] += (rates * tokens) @ p
                    out[k, kinds:] += ((p * (tokens * free)[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["k", "x"])

        got = table.mapInArrow(add, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros(len(tries) * n)
        out[got["k"].to_numpy()] = got["x"].to_numpy()
        return [(x[:kinds], x[kinds:].reshape(kinds, kinds)) for x in out.reshape(-1, n)]

    still = np.zeros(kinds)
    ((now, gram),) = totals([], [still], still)
    want = np.asarray(targets(now) if callable(targets) else [targets.get(k, 0.0) for k in model.domains], float)
    scale = np.maximum(now, 1e-9 * max(now.sum(), 1.0))
    miss = lambda x: float(((x - want) ** 2 / scale).sum())
    near = lambda: np.abs(now - want).sum() <= close * max(want.sum(), 1.0)
    if not low < 1.0 < high and not near():  # the rates start at a bound
        ((_, gram),) = totals([], [still], (want - now) / scale)
    trace, misses = [now], [miss(now)]
    while not near():
        whole = np.linalg.solve(gram + 1e-9 * np.diag(scale), now - want)
        tries = [*(part * whole for part in PARTS), (now - want) / scale]
        found = zip(tries, totals(model.steps, tries, (want - now) / scale), strict=True)
        better = next(((g, *x) for g, x in found if miss(x[0]) < misses[-1]), None)
        if better:
            step, now, gram = better
            model.steps.append(step)
            trace.append(now)
            misses.append(miss(now))
        if not better or len(misses) > STALL and not near() and misses[-1] > (1 - STALL_GAIN) * misses[-1 - STALL]:
            missed = ", ".join(f"{k!r}: {x:.6g} of {w:.6g}" for k, x, w in zip(model.domains, now, want, strict=True))
            LOG.warning("mixing targets not reached after %d steps; expected tokens reached of wanted: %s", len(model.steps), missed)
            break
    return model, [dict(zip(model.domains, x.tolist(), strict=True)) for x in trace]


def tempered(power: float, keep_all: bool = False):
    """Targets proportional to the observed totals to ``power``; of the same sum, or, with keep_all, so large that no domain shrinks."""

    def targets(base: np.ndarray) -> np.ndarray:
        share = np.where(base > 0, np.maximum(base, 1e-12) ** power, 0.0)
        if not share.sum():
            return base
        share = share / share.sum()
        return share * (np.max(base[share > 0] / share[share > 0]) if keep_all else base.sum())

    return targets


def apply_rates(docs: DataFrame, model: Mixture) -> tuple[DataFrame, list[str]]:
    """``docs`` with four more columns, and their names: tokens, the likeliest domain, rate, and copies (the rate's whole part, and one more by a hash of id and text)."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names, text_at = docs.columns, docs.columns.index("text")
    tokens_, domain, rate, copies = own = fresh(docs, "__tokens", "__domain", "__rate", "__copies")
    schema = docs.select("*").schema.add(tokens_, "long").add(domain, "string").add(rate, "double")

    def run(batches):
        m = shipped.value
        for b in batches:
            tokens, p = m.posterior(b.column(text_at))
            kinds = [m.domains[i] for i in p.argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens.astype(np.int64)), pa.array(kinds, pa.string()), pa.array(m.rates(tokens, p))], names=[*names, *own[:3]])

    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor(rate)
    return docs.mapInArrow(run, schema).withColumn(copies, (whole + (chance < F.col(rate) - whole).cast("long")).cast("int")), own


def mixed(docs: DataFrame, labels: DataFrame, power: float = 0.7) -> DataFrame:
    """``docs`` repeated so that domains' expected tokens follow ``tempered`` weights and no document is lost."""
    model, _ = fit_rates(docs, classifier(docs, labels), tempered(power, keep_all=True), low=1.0)
    out, (*_, copies) = apply_rates(docs, model)
    (again,) = fresh(out, "__again")
    return out.withColumn(again, F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).select(*[F.col(f"`{c}`") for c in docs.columns])
