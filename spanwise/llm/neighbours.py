"""Approximate nearest neighbours by cosine with randomly rotated one-bit codes.

Each vector is scaled to length one and turned by a seeded random rotation. Its
code keeps the signs of the turned coordinates (packed bits) and one correction
scalar f, the inner product of the turned vector with its own code. For a query q,
<code, q> / f estimates the cosine without bias, with an error below
EPSILON * sqrt((1 - f^2) / f^2 / (D - 1)) but for a chance that falls off like
exp(-c EPSILON^2) (Gao and Long 2024). A candidate is reranked with its original
vector, in double precision, unless estimate plus bound is below the k-th best
exact score that is known so far.

Queries go by blocks of at most QUERIES, a bounded broadcast each; every block
meets all vectors, in their own partitions, and only k rows a query and partition
come out. Codes are staged once in the shared folder beside the vectors.

Vectors that are null, zero or hold null or non-finite components take no part,
as queries or candidates; vectors of different lengths are never compared. Rows
that share the query's id are its own and no candidates of it; if several rows
have a query's id, the least vector in array order asks. Other repeated rows are
candidates each. Ties go to the smaller id. Extra columns are ignored; an empty
table, of queries or of vectors, gives no rows. Components of any magnitude are
fine: vectors are scaled by powers of two before they are multiplied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import process_cache
from .shared import stage_table

EPSILON = 2.5
QUERIES = 4_096
#: Codes compared with a block of queries at once.
ROWS = 1_024
SEED = 7


def rotation(dim: int) -> np.ndarray:
    """The seeded random rotation of ``dim`` dimensions, made once in a process."""
    kept = process_cache().setdefault("rotations", {})
    if dim not in kept:
        q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
        kept[dim] = q * np.sign(np.diag(r))
    return kept[dim]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is of 0.5 to 1: exact, leaves cosines as they are, and no square over- or underflows."""
    _, power = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    # In two steps: the whole factor may itself be too large or too small for a double.
    half = -power // 2
    return np.ldexp(np.ldexp(vectors, half[:, None]), (-power - half)[:, None])


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction scalars) of the rows of a float64 matrix."""
    dim = vectors.shape[1]
    turned = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ rotation(dim)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(dim)


def decode(codes: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors of packed codes."""
    return (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two float64 matrices, summed from the first component to the last."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(a, a))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two float64 matrices."""
    a, b = scaled(a), scaled(b)
    return dots(a, b) / (norms(a) * norms(b))


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    v = F.col(column).cast("array<double>")
    ready = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return ready.where(F.coalesce(good, F.lit(False)))


def _matrices(batch):
    """(dimension, row numbers, float64 matrix) for each length of vectors in a batch."""
    lists = batch.column("v")
    flat, offs = lists.flatten().to_numpy(), np.asarray(lists.offsets)
    offs = offs - offs[0]
    sizes = np.diff(offs)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, scaled(flat[offs[rows][:, None] + np.arange(dim)])


def build_index(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v, code, f) of every vector that takes part, staged in the shared folder."""

    def run(batches):
        for b in batches:
            codes, f = [b""] * b.num_rows, np.zeros(b.num_rows)
            for _, rows, m in _matrices(b):
                packed, scalars = encode(m)
                f[rows] = scalars
                for r, c in zip(rows, packed, strict=True):
                    codes[r] = c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(codes, pa.binary()), pa.array(f)], ["vec_id", "v", "code", "f"])

    return stage_table(usable(vectors, key, column).mapInArrow(run, "vec_id long, v array<double>, code binary, f double"), "codes")


def _near(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Task: the k nearest rows of its partition for each query; queries by dimension: (ids, matrix)."""

    def rerank(state, ids, m, sizes, names, hq, hr):
        """Exact scores of the pairs (query hq, row hr), merged into each query's best k."""
        best, who = state["best"], state["who"]
        for part in range(0, len(hq), 1 << 16):
            pq, pr = hq[part : part + (1 << 16)], hr[part : part + (1 << 16)]
            other = names[pr] != ids[pq]
            pq, pr = pq[other], pr[other]
            exact = np.zeros(len(pq))
            for i in range(len(m)):  # as dots() does, by component: short contiguous columns stay in the cache
                exact += state["columns"][i][pq] * m[i][pr]
            exact /= state["sizes"][pq] * sizes[pr]
            good = exact >= best[pq, -1]
            pq, pr, exact = pq[good], pr[good], exact[good]
            touched, own = np.unique(pq, return_inverse=True)
            owner = np.concatenate([own, np.repeat(np.arange(len(touched)), k)])
            score = np.concatenate([exact, best[touched].ravel()])
            name = np.concatenate([names[pr], who[touched].ravel()])
            order = np.lexsort((name, -score, owner))
            first = np.searchsorted(owner[order], np.arange(len(touched)))
            take = order[first[:, None] + np.arange(k)]
            best[touched], who[touched] = score[take], name[take]

    def run(batches):
        state = {}
        for dim, (ids, q) in queries.items():
            q = scaled(q)
            unit = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ rotation(dim)
            state[dim] = {"columns": np.ascontiguousarray(q.T), "unit": unit.astype(np.float32), "sizes": norms(q), "best": np.full((len(ids), k), -np.inf), "who": np.full((len(ids), k), np.iinfo(np.int64).max)}
        for b in batches:
            ids_all, scalars, packed = b.column("vec_id").to_numpy(), b.column("f").to_numpy(), b.column("code").to_pylist()
            for dim, rows, m_all in _matrices(b):
                if dim not in state:
                    continue
                ids, mine = queries[dim][0], state[dim]
                for lo in range(0, len(rows), ROWS):
                    at, m = rows[lo : lo + ROWS], m_all[lo : lo + ROWS]
                    codes = decode(np.frombuffer(b"".join(packed[r] for r in at), np.uint8).reshape(len(at), -1), dim)
                    f, names, sizes = scalars[at], ids_all[at], norms(m)
                    guess = mine["unit"] @ (codes / f[:, None].astype(np.float32)).T
                    bound = (EPSILON * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / max(dim - 1, 1)) + 1e-5).astype(np.float32)
                    # The best guesses first: their exact scores let the bound drop most others.
                    turned = np.ascontiguousarray(m.T)
                    few = min(k + 1, len(at))
                    top = np.argpartition(guess, len(at) - few, axis=1)[:, len(at) - few :]
                    rerank(mine, ids, turned, sizes, names, np.repeat(np.arange(len(ids)), few), top.ravel())
                    floor = mine["best"][:, -1:].astype(np.float32) - 1e-6
                    np.put_along_axis(guess, top, -np.inf, axis=1)
                    guess += bound
                    rerank(mine, ids, turned, sizes, names, *np.nonzero((guess >= floor) & (guess > -np.inf)))
        for dim, (ids, _) in queries.items():
            best, who = state[dim]["best"], state[dim]["who"]
            at, col = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(who[at, col]), pa.array(best[at, col])], ["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (vec_id, v)."""
    spark = index.sparkSession
    asked = stage_table(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    block, done = [], []

    def ask(rows):
        by: dict = {}
        for r in rows:
            by.setdefault(len(r.v), []).append(r)
        shipped = spark.sparkContext.broadcast({dim: (np.array([r.vec_id for r in rs], np.int64), np.array([r.v for r in rs], np.float64)) for dim, rs in by.items()})
        return index.mapInArrow(lambda batches: _near(shipped.value, k)(batches), "query_id long, vec_id long, score double"), shipped

    def finish(rows):
        # One block's vectors at a time are held, here and by the executors.
        near, shipped = ask(rows)
        done.append(stage_table(near, "near"))
        shipped.destroy()

    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) > QUERIES:
            finish(block[:-1])
            block = block[-1:]
    if done:
        finish(block)
        found = spark.read.schema(done[0].schema).parquet(*[d._staged_at for d in done])
    else:
        found, _ = ask(block)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
), u AS (
  SELECT vec_id, v FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
  FROM (SELECT vec_id, min(v) AS v FROM u WHERE vec_id % 50 = 0 GROUP BY vec_id) q JOIN u c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
