"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage_table, unstage


class Forest:
    """Union-find over 0..n-1; the root of a set is its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def contract(batches):
    """Replace each batch's edges (a, b) by the stars of their components: far fewer, same components."""
    for b in batches:
        a, c = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        names, at = np.unique(np.concatenate([a, c]), return_inverse=True)
        forest = Forest(len(names))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            forest.join(x, y)
        roots = np.array([forest.find(i) for i in range(len(names))], dtype=np.int64)
        own = np.flatnonzero(roots != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[own], pa.int64()), pa.array(names[roots[own]] if len(own) else names[:0], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b), roots being least nodes; roots themselves are left out.

    Each round writes its edges to the shared folder, so lineage stays short and
    no executor's loss repeats more than a round. Joins are on a node with plain
    aggregates, never a list of a node's neighbours, so hubs stay splittable.
    """
    now = stage_table(edges.select("a", "b").mapInArrow(contract, "a long, b long").distinct(), "edges")
    before = None
    while True:
        print_ = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == print_:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = print_
        # Large star: neighbours above u go to the least of u and all its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = now.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: u and its neighbours below go to the least of those.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        done = now
        now = stage_table(small.where("a <> b").mapInArrow(contract, "a long, b long").distinct(), "edges")
        unstage(done)
