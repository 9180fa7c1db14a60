"""Language identification by prediction by partial matching over bytes.

For each language, counts of bytes after contexts of up to ORDER bytes (a
variable-order context tree) are taken from a bounded sample of labelled
documents and then frozen. The code length of a byte follows PPM with escape
method C and exclusion: after a context with T counts of D kinds, a seen byte
costs -log2(n / (T + D)); otherwise an escape of D / (T + D) leads to the next
shorter context, bytes seen in the longer one being excluded, down to a uniform
order. Since the statistics are frozen, every (context, byte) has one fixed cost:
hash tables hold those of all that was seen, with the escapes that give the others,
and a text's exact code length is the sum of its bytes' costs.

Bytes are taken from the lower-cased text, runs of other ASCII than letters
being one space. Bytes unseen in training share one symbol, which loses nothing: no
context holds one, so to tell them apart costs the same in every language. The
language of the shortest code wins (ties: the first by name). ``und`` with score 0 is given to
null texts and texts without a letter, and to all when nothing was learned.
Repeated rows are predicted each; extra columns are ignored; an empty table gives
no rows. A very long text is scored in pieces.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytetext as bt
from .shared import held_out, small_batches

ORDER = 3
#: Training documents of each language at most (in hash order of doc_id).
TRAIN_ROWS = 600
#: Bytes of text that are scored at once.
PIECE = 1 << 19
#: Languages that share a table of costs; bits of a byte at most.
TOGETHER, MOST_BITS = 8, -np.log2(1e-30)
WORDLIKE = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether a text holds a character of Unicode's category L; other signs, like those of numbers, are no letters."""
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def normal_bytes(column: pa.Array) -> pa.Array:
    """Lower-cased texts with each run of ASCII non-letters as one space."""
    text = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    return pc.replace_substring_regex(text, r"[\x00-\x60\x7B-\x7F]+", " ")


class Places:
    """Row numbers of distinct codes, by open addressing in a table at most half full."""

    def __init__(self, codes: np.ndarray):
        bits = max(4, (2 * len(codes)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.codes, self.rows = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(codes)), self.slots(codes)
        while len(left):
            free = self.codes[slot] < 0
            self.codes[slot[free]] = codes[left[free]]
            mine = self.codes[slot] == codes[left]
            self.rows[slot[mine]] = left[mine]
            left, slot = left[~mine], (slot[~mine] + 1) & self.mask

    def slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The row of each code, -1 where there is none."""
        slot = self.slots(codes)
        held = self.codes[slot]
        out = np.where(held == codes, self.rows[slot], -1)
        left = np.flatnonzero((held != codes) & (held >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            held = self.codes[slot]
            hit = held == codes[left]
            out[left[hit]] = self.rows[slot[hit]]
            more = ~hit & (held >= 0)
            left, slot = left[more], slot[more]
        return out


def among(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each code stands in ``sorted_codes``, and whether it does."""
    at = np.minimum(np.searchsorted(sorted_codes, codes), max(0, len(sorted_codes) - 1))
    return at, sorted_codes[at] == codes if len(sorted_codes) else np.zeros(len(codes), bool)


class CostTable:
    """Bits of bytes in some languages, held for the seen codes and contexts only.

    For each order: rows of bits of the codes that any of the languages has seen, and
    of the escapes from the contexts that any has seen (0 for the others: a context
    that was never seen leads to the shorter one free of charge).
    """

    def __init__(self, size: int, uniform: np.ndarray, counts: list[list[tuple[np.ndarray, np.ndarray]]]):
        self.size, self.floor, self.levels = size, -np.log2(np.maximum(uniform, 1e-30)), []
        own = [self.language(orders, uniform) for orders in counts]
        for order in range(ORDER + 1):
            codes = np.unique(np.concatenate([x[order][0] for x in own]))
            contexts = np.unique(np.concatenate([x[order][2] for x in own]))
            bits, escapes = np.empty((len(codes), len(own)), np.float32), np.zeros((len(contexts), len(own)), np.float32)
            for k, x in enumerate(own):
                bits[:, k] = np.minimum(self.exact(x, order, codes), MOST_BITS)
                at, ok = among(x[order][2], contexts)
                escapes[ok, k] = x[order][3][at[ok]]
            self.levels.append((Places(codes), bits, Places(contexts), escapes))

    def language(self, orders, uniform: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """For each order of one language: seen codes, their bits, seen contexts, bits of their escapes."""
        out: list = []
        for order, (codes, n) in enumerate(orders):
            if not len(codes):
                out.append((codes, np.empty(0), codes, np.empty(0)))
                continue
            contexts, first, back = np.unique(codes // self.size, return_index=True, return_inverse=True)
            total, kinds = np.add.reduceat(n, first), np.bincount(back)
            # Exclusion: what the shorter context gives to bytes not seen in this one, scaled to sum to one.
            base = np.exp2(-self.exact(out, order - 1, codes % self.size**order)) if order else uniform[codes]
            rest = 1 - np.add.reduceat(base, first)
            ends = rest <= 1e-12
            escape = np.where(ends, 1e-30, kinds / (total + kinds) / np.where(ends, 1, rest))
            out.append((codes, -np.log2(n / np.where(ends, total, total + kinds)[back]), contexts, -np.log2(escape)))
        return out

    def exact(self, levels, order: int, codes: np.ndarray) -> np.ndarray:
        """Bits of codes of ``order`` in one language."""
        if order < 0:
            return self.floor[codes]
        seen, bits, contexts, escapes = levels[order]
        at, ok = among(seen, codes)
        out = np.zeros(len(codes))
        out[ok] = bits[at[ok]]
        missed = np.flatnonzero(~ok)
        if len(missed):
            at, ok = among(contexts, codes[missed] // self.size)
            out[missed[ok]] = escapes[at[ok]]
            out[missed] += self.exact(levels, order - 1, codes[missed] % self.size ** max(order, 1))
        return out

    def bits(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of each code of ``order`` by language, float32."""
        places, bits, contexts, escapes = self.levels[order]
        at = places.find(codes)
        out = bits[at] if len(bits) else np.zeros((len(codes), bits.shape[1]), np.float32)
        missed = np.flatnonzero(at < 0)
        if len(missed):
            shorter = codes[missed]
            at = contexts.find(shorter // self.size)
            more = escapes[at] * (at >= 0)[:, None] if len(escapes) else 0
            lower = self.bits(shorter % self.size**order, order - 1) if order else self.floor[shorter, None]
            out[missed] = np.minimum(lower + more, MOST_BITS)
        return out


@dataclass
class ContextTrees:
    """Byte to symbol, and for each language and order the sorted (context and symbol) codes with their counts."""

    languages: list[str]
    symbol: np.ndarray
    size: int
    counts: list[list[tuple[np.ndarray, np.ndarray]]]

    def tables(self) -> list[CostTable]:
        """Tables of TOGETHER languages each, in order."""
        # All 256 bytes alike; the last symbol stands for all that no training text holds.
        uniform = np.bincount(self.symbol, minlength=self.size) / 256
        return [CostTable(self.size, uniform, self.counts[k : k + TOGETHER]) for k in range(0, len(self.languages), TOGETHER)]

    def costs(self) -> np.ndarray:
        """Bits of every (context of ORDER symbols, symbol) in each language, of shape (size**(ORDER + 1), languages): for small alphabets."""
        codes = np.arange(self.size ** (ORDER + 1))
        return np.concatenate([t.bits(codes) for t in self.tables()], axis=1)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> ContextTrees:
    """Count contexts over a bounded sample of documents whose lang is known and which aren't held out."""
    ready = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang")
    # The least hashes of each language: rows are counted by the hash's first bits, so that few candidates meet in a language's task.
    ready = ready.withColumn("hash", F.xxhash64("doc_id")).withColumn("bin", F.shiftright("hash", 54).cast("int"))
    reach, held = {}, {}
    for r in ready.groupBy("lang", "bin").count().orderBy("lang", "bin").collect():  # at most 1,024 rows a language
        if held.setdefault(r.lang, 0) < rows:
            reach[r.lang] = r.bin
        held[r.lang] += r["count"]
    names = sorted(reach)
    if not names:
        return ContextTrees([], np.zeros(256, np.int64), 1, [])
    bounds = ready.sparkSession.createDataFrame(list(reach.items()), "lang string, reach int")
    near = ready.join(F.broadcast(bounds), "lang").where("bin <= reach")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    picks = near.withColumn("place", place).where(F.col("place") <= rows).select("doc_id", "lang")
    sample = docs.select("doc_id", "text").join(F.broadcast(picks.distinct()), "doc_id")
    size = 256

    def grams(batches):
        """Counts of (language, order, code) over a batch; code packs up to ORDER + 1 raw bytes."""
        for b in batches:
            langs, own = np.unique(np.array(b.column("lang").to_pylist(), dtype=str), return_inverse=True)
            found: dict = {}
            for lo, n, buf, offs in bt.blocks(normal_bytes(b.column("text"))):
                row = np.repeat(np.arange(n), np.diff(offs))
                place = np.arange(len(buf)) - offs[row]
                code = np.zeros(len(buf), np.int64)
                for order in range(ORDER + 1):
                    if order:
                        code[order:] += buf[:-order].astype(np.int64) * size**order
                    else:
                        code += buf
                    ok = place >= order
                    values, counts = np.unique(code[ok] + (own[lo : lo + n][row[ok]] << 32), return_counts=True)
                    found.setdefault(order, []).append((values, counts))
            out = [[], [], [], []]
            for order, parts in found.items():
                values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                out[0] += langs[values >> 32].tolist()
                out[1] += [order] * len(values)
                out[2].append(values & 0xFFFFFFFF)
                out[3].append(counts)
            join = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(join(out[2]), pa.int64()), pa.array(join(out[3]), pa.int64())], ["lang", "order", "code", "n"])

    table = sample.mapInArrow(grams, "lang string, order int, code long, n long").groupBy("lang", "order", "code").agg(F.sum("n").alias("n")).toArrow()
    langs, orders = np.array(table.column("lang").to_pylist(), dtype=str), table.column("order").to_numpy()
    codes, counts = table.column("code").to_numpy(), table.column("n").to_numpy()
    known = np.unique(codes[orders == 0])
    size = len(known) + 1  # the last symbol stands for all bytes that the sample lacks
    symbol = np.full(256, len(known), np.int64)
    symbol[known] = np.arange(len(known))
    trees = []
    for name in names:
        own = []
        for order in range(ORDER + 1):
            at = (langs == name) & (orders == order)
            packed = np.zeros(at.sum(), np.int64)
            for k in range(order, -1, -1):
                packed = packed * size + symbol[(codes[at] >> (8 * k)) & 255]
            values, back = np.unique(packed, return_inverse=True)
            own.append((values, np.bincount(back, weights=counts[at], minlength=len(values))))
        trees.append(own)
    return ContextTrees(names, symbol, size, trees)


def context_codes(trees: ContextTrees, buf: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The code of each byte of ``buf`` from ``lo`` to ``hi`` with the ORDER bytes before it; before a text's start are spaces."""
    first = max(0, lo - ORDER)
    s, blank = trees.symbol[buf[first:hi]], int(trees.symbol[0x20])
    starts = offs[:-1][(offs[:-1] >= first) & (offs[:-1] < hi) & (np.diff(offs) > 0)]
    code = s.copy()
    for k in range(1, ORDER + 1):
        earlier = np.full(len(s), blank)
        earlier[k:] = s[:-k]
        for j in range(k):
            at = starts + j
            # A text shorter than that ends before: its successor's start blanks what follows.
            earlier[at[at < hi] - first] = blank
        code += earlier * trees.size**k
    return code[lo - first :]


def predict(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``; score is the posterior of the winner at equal priors."""
    shipped = docs.sparkSession.sparkContext.broadcast(trees)
    tag = f"costs-{uuid.uuid4().hex}"  # Python workers live on, and may have served other trees

    def run(batches):
        t = shipped.value
        kept = bt.process_cache()
        if t.languages and tag not in kept:
            for old in [k for k in kept if str(k).startswith("costs-")]:
                del kept[old]
            kept[tag] = t.tables()
        for b in batches:
            text = b.column("text")
            bits = np.zeros((b.num_rows, max(1, len(t.languages))))
            plain = [x is not None and has_letter(x) for x in text.to_pylist()]
            if t.languages:
                for lo, n, buf, offs in bt.blocks(normal_bytes(text), PIECE):
                    for a in range(0, len(buf), PIECE):  # a very long text goes by pieces
                        code = context_codes(t, buf, offs, a, min(a + PIECE, len(buf)))
                        cut = np.clip(offs, a, a + len(code)) - a
                        for g, table in enumerate(kept[tag]):
                            found = table.bits(code)
                            sums = np.zeros((len(code) + 1, found.shape[1]))
                            np.cumsum(found, axis=0, dtype=np.float64, out=sums[1:])
                            bits[lo : lo + n, g * TOGETHER : g * TOGETHER + found.shape[1]] += sums[cut[1:]] - sums[cut[:-1]]
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            ok = np.array(plain, bool) & bool(t.languages)
            names = [t.languages[i] if good else UNKNOWN for i, good in zip(best, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(ok, share, 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def predicted_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    out = predict(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
