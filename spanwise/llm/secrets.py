r"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Base spans, leftmost and non-overlapping per kind, in code points: ``assign``
(a password-like name, a separator and a value of 6 or more characters),
``access`` (AKIA and more, 20 or more characters), ``hex`` (24 or more). They
always stay. The method adds ``random`` spans:

* Candidates are parts of MIN_LENGTH or more that meet no base span: runs of
  [A-Za-z0-9+/_-] between '=', and what is left of them when cut at '+/', at '-_'
  and at all four, so that a key is tested without the name or path that it is
  joined to. The encoding is inferred as the smallest alphabet that holds the part
  (decimal, hex, base32, lower-case or mixed letters, base36, base62, base64); a
  part that none holds is tested in its cuts only. Accepted parts that overlap
  are one span.
* Each candidate gets three p-values under "drawn uniformly from the alphabet":
  a chi-squared test of uniformity, a runs test about the alphabet's median, and a
  lag-1 serial correlation test. The least of them, times three, is the battery's
  p-value. Chi-squared is taken over the letters of the alphabet, with the exact mean
  and variance of the statistic, as most letters are expected less than once; and over
  at most BUCKETS equal classes of letters, where its own distribution holds: the
  lesser of the two p-values, times two.
* Words fail the battery, random strings pass it evenly over p. So, for each
  encoding and length class, over all documents: strings with p of HALF or more
  are counted, twice that count estimates the random ones (Storey's
  argument), and the estimated share of others among those with p of at least a
  cut is the false-discovery rate of accepting from that cut on. The least cut on
  a grid with a rate of at most FDR is used; a class without one accepts
  nothing, nor does a class whose alphabet and length leave fewer than
  MIN_BITS bits.

Only the grid's counts (bounded) reach the driver. Null texts count as empty.
Repeated rows are scanned and counted each. Extra columns are ignored; an empty table
gives no rows. A very long text is scanned whole, in one piece.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, stage_table

# Fixed patterns of the base kinds, in their fixed order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

MIN_LENGTH, MIN_BITS, BUCKETS, HALF, FDR, GRID = 20, 64.0, 8, 0.5, 0.05, 40
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
#: Ways to cut a run into parts; the first takes it whole.
CUTS = tuple(re.compile(x) for x in (r"[^=]+", r"[^=+/]+", r"[^=_-]+", r"[^=+/_-]+"))
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets from the smallest; the first that holds a run is its encoding.
ALPHABETS = {
    "decimal": DIGITS, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "lower": LOWER, "upper": UPPER, "base32": UPPER + "234567",
    "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER, "letters": UPPER + LOWER, "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
}

LETTERS = {name: frozenset(letters) for name, letters in ALPHABETS.items()}
#: What a text holds, lower-cased, wherever ASSIGN matches.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str, runs: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, ascending. ``runs``: whether CANDIDATE matches, without which two kinds can't."""
    found, low = [], text.lower()
    if any(x in low for x in NAMES):
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if runs:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def encoding(run: str) -> str | None:
    held = set(run)
    return next((name for name, letters in LETTERS.items() if held <= letters), None)


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_tail(x: float, k: int) -> float:
    """Upper tail at ``k`` degrees of freedom (Wilson and Hilferty's cube-root normal approximation)."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: str, letters: str) -> float:
    """The battery's p-value of ``run`` over the alphabet ``letters``."""
    size, n = len(letters), len(run)
    place = np.zeros(128, np.int64)
    place[np.frombuffer(letters.encode(), np.uint8)] = np.arange(size)
    at = place[np.frombuffer(run.encode(), np.uint8)]
    k = min(BUCKETS, size)
    # Letters are dealt to buckets in turn, so that neighbours in the alphabet differ in bucket.
    expected = np.bincount(np.arange(size) % k, minlength=k) * n / size
    counts = np.bincount(at % k, minlength=k)
    p1 = chi_squared_tail(float(((counts - expected) ** 2 / expected).sum()), k - 1)
    # Over all letters: mean and variance of the statistic are those of a uniform draw; only an excess counts.
    x = float((np.bincount(at, minlength=size) ** 2).sum()) * size / n - n
    p1 = min(1.0, 2 * min(p1, normal_tail((x - size + 1) / math.sqrt(2 * (size - 1) * (n - 1) / n)) if x > size - 1 else 1.0))
    high = at * 2 >= size
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mu = 2 * a * b / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        p2 = normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mu) / math.sqrt(max(var, 1e-9)))
    else:
        p2 = 2.0 ** (1 - n)
    centred = at - at.mean()
    spread = float((centred**2).sum())
    p3 = normal_tail(((centred[1:] * centred[:-1]).sum() / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    return min(1.0, 3 * min(p1, p2, p3))


def candidates(runs, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
    """(start, end, class, p) of each candidate in matches of CANDIDATE that meets no span of ``taken``; the class is its encoding and length class."""
    found, starts, reach = [], [s for s, _, _ in taken], list(accumulate((e for _, _, e in taken), max))
    for m in runs:
        inner = m[0].rstrip("=")
        for lo, hi in sorted({x.span() for cut in CUTS for x in cut.finditer(inner) if x.end() - x.start() >= MIN_LENGTH}):
            # Padding belongs to the part before it.
            start, end = m.start() + lo, m.start() + hi if hi < len(inner) else m.end()
            before = bisect_left(starts, end)  # spans that start before the end; one of them may reach into the part
            if before and reach[before - 1] > start:
                continue
            part = inner[lo:hi]
            name = encoding(part)
            if name and len(part) * math.log2(len(ALPHABETS[name])) >= MIN_BITS:
                found.append((start, end, f"{name}:{int(2 * math.log2(len(part)))}", battery(part, ALPHABETS[name])))
    return found


def cuts(counts: dict[tuple[str, int], int]) -> dict[str, float]:
    """The least accepted p of each class, from the numbers of candidates by class and grid cell."""
    out = {}
    for name in {k for k, _ in counts}:
        cells = np.array([counts.get((name, i), 0) for i in range(GRID + 1)], float)
        half = int(HALF * GRID)
        random = cells[half:].sum() / (1 - HALF)
        for i in range(GRID):
            accepted = cells[i:].sum()
            if accepted and 1 - min(1.0, random * (1 - i / GRID) / accepted) <= FDR:
                out[name] = i / GRID
                break
    return out


def merged(spans: Column) -> Column:
    """Spans (start, end) with overlapping ones joined."""

    def add(done, m):
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], m["end"]).alias("end"))
        return F.when(last["end"] > m["start"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(m)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int>>"), add)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of ``docs``."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, base array<struct<start:int,kind:int,end:int>>, more array<struct<start:int,end:int,class:string,p:double>>"

    def run(batches):
        for b in batches:
            base, more = [], []
            for text in b.column(1).to_pylist():
                runs = list(CANDIDATE.finditer(text or ""))
                base.append(base_spans(text or "", bool(runs)))
                more.append(candidates(runs, base[-1]))
            kinds = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
            extra = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.string()), ("p", pa.float64())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[dict(zip(("start", "kind", "end"), x, strict=True)) for x in s] for s in base], pa.list_(kinds)), pa.array([[dict(zip(("start", "end", "class", "p"), x, strict=True)) for x in s] for s in more], pa.list_(extra))], ["doc_id", "base", "more"])

    found = stage_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "spans")
    cells = found.select(F.explode("more").alias("m")).groupBy(F.col("m.class").alias("c"), F.floor(F.col("m.p") * GRID).cast("int").alias("i")).count()
    accept = cuts({(r.c, r.i): r["count"] for r in cells.collect()})  # at most encodings x length classes x grid cells
    least = F.create_map(*[F.lit(x) for k in sorted(accept) for x in (k, accept[k])]) if accept else F.create_map().cast("map<string,double>")
    random = F.filter("more", lambda m: F.coalesce(m["p"] >= least[m["class"]], F.lit(False)))
    random = merged(F.transform(random, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
    spans = F.array_sort(F.concat("base", F.transform(random, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text("base"), 256).alias("base_sha256"), text(spans).alias("spans"))
