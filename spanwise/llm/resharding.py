"""Minimum-cost-flow resharding: move the fewest bytes from old shards to new capacities.

Rows are grouped into blocks (old shard, hash of the row); only the blocks'
sizes reach the driver: BLOCKS of them, or one for each old shard if there are
more of those. Supplies are the old shards' bytes, capacities those of the new
ones; staying costs nothing and moving costs one a byte. The flow is solved
exactly; the blocks of a shard are then dealt largest first to the transfer with
the most left, carrying each new shard's rounding on, so sizes come out equal to
about one block. A join with the plan places the rows; slots count up within a
shard, block by block. Rows are shuffled once, to parts of a shard of some
PART_BYTES, in which they lie by slot.

write_shards() rewrites only shards that gain or lose rows; the files of the others
stay where they are, and a manifest, written last and in one rename, joins both.
read_shards() reads by the manifest.

Null texts count as no bytes, as empty ones do. Equal rows are placed each: those of
tables read from Parquet are told apart by their places in the file, others share a
block. Rows with a null doc_id are placed like others. Other columns, whatever their
names, pass through. An empty table gives no rows. A very long text is a block's
part like any row, so that no shard can be closer to its capacity than its size.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..sources.files import read_file, replace_file
from .shared import bounded, fresh, row_index

#: Blocks over all old shards, unless there are more old shards.
BLOCKS = 32_768
ROW_OVERHEAD = 16
#: Bytes of a part of a shard, on average: a task's work, and a file of a rewritten shard.
PART_BYTES = 64 << 20
MANIFEST = "manifest.json"


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_OVERHEAD


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost) of a maximum flow of least cost.

    Primal-dual: for each distance of the sink in turn, blocking flows over the edges
    that lie on shortest paths. Costs of 0 and 1 leave few distances, so the work is
    about linear in the edges.
    """
    out, to, left, cost = [[] for _ in range(n)], [], [], []
    for a, b, capacity, price in edges:
        for u, v, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[u].append(len(to))
            to.append(v)
            left.append(c)
            cost.append(p)
    while True:
        far, queue, queued = [None] * n, deque([source]), [False] * n
        far[source] = 0
        while queue:
            u = queue.popleft()
            queued[u] = False
            for e in out[u]:
                v = to[e]
                if left[e] > 0 and (far[v] is None or far[u] + cost[e] < far[v]):
                    far[v] = far[u] + cost[e]
                    if not queued[v]:
                        queued[v] = True
                        (queue.append if cost[e] > 0 else queue.appendleft)(v)
        if far[sink] is None:
            return [edges[i][2] - left[2 * i] for i in range(len(edges))]
        tight = lambda e, u: left[e] > 0 and far[to[e]] == far[u] + cost[e]  # noqa: B023, E731
        while _blocking_flow(n, out, to, left, tight, source, sink):
            pass


def _blocking_flow(n: int, out, to, left, tight, source: int, sink: int) -> bool:
    """Push flow along tight edges by levels until no path of that length is left; False if there was none."""
    level, queue = [-1] * n, deque([source])
    level[source] = 0
    while queue:
        u = queue.popleft()
        for e in out[u]:
            if level[to[e]] < 0 and tight(e, u):
                level[to[e]] = level[u] + 1
                queue.append(to[e])
    if level[sink] < 0:
        return False
    at, path, u = [0] * n, [], source
    while True:
        if u == sink:
            amount = min(left[e] for e in path)
            for e in path:
                left[e] -= amount
                left[e ^ 1] += amount
            first = next(i for i, e in enumerate(path) if not left[e])
            u = to[path[first] ^ 1]
            del path[first:]
            continue
        while at[u] < len(out[u]):
            e = out[u][at[u]]
            if level[to[e]] == level[u] + 1 and tight(e, u):
                break
            at[u] += 1
        if at[u] < len(out[u]):
            path.append(out[u][at[u]])
            u = to[path[-1]]
        elif u == source:
            return True
        else:
            u = to[path.pop() ^ 1]
            at[u] += 1


def plan_transfers(old: list[int], capacities: list[int]) -> list[dict[int, int]]:
    """For each old shard, bytes that go to each new shard. Old shard i and new shard i are the same place; a move passes a hub at cost 1 a byte."""
    n, m = len(old), len(capacities)
    source, hub, sink = n + m, n + m + 1, n + m + 2
    edges = [(source, i, size, 0) for i, size in enumerate(old)]
    stay = len(edges)
    edges += [(i, n + i, old[i], 0) for i in range(min(n, m))]
    leave = len(edges)
    edges += [(i, hub, old[i], 1) for i in range(n)]
    enter = len(edges)
    edges += [(hub, n + j, capacities[j], 0) for j in range(m)]
    edges += [(n + j, sink, capacities[j], 0) for j in range(m)]
    flow = min_cost_flow(n + m + 3, edges, source, sink)
    plan: list[dict[int, int]] = [{} for _ in range(n)]
    for i in range(min(n, m)):
        if flow[stay + i]:
            plan[i][i] = flow[stay + i]
    wanted = deque((j, flow[enter + j]) for j in range(m) if flow[enter + j])
    for i in range(n):
        amount = flow[leave + i]
        while amount:
            j, need = wanted.popleft()
            take = min(amount, need)
            plan[i][j] = plan[i].get(j, 0) + take
            amount -= take
            if need > take:
                wanted.appendleft((j, need - take))
    return plan


def deal_blocks(blocks: list[tuple[int, int, int]], plan: list[dict[int, int]]) -> dict[tuple[int, int], int]:
    """New shard of each block (old shard, block, bytes)."""
    out, carry = {}, defaultdict(int)
    mine = defaultdict(list)
    for i, b, size in blocks:
        mine[i].append((-size, b))
    for i in sorted(mine):
        heap = [(-(amount + carry[j]), j) for j, amount in plan[i].items()] or [(0, 0)]
        heapq.heapify(heap)
        for size, b in sorted(mine[i]):
            rest, j = heapq.heappop(heap)
            out[i, b] = j
            heapq.heappush(heap, (rest - size, j))
        for rest, j in heap:
            carry[j] = -rest
    return out


def old_shard(docs: DataFrame) -> Column:
    """The file that a row lies in, where ``docs`` is read from files; else one shard."""
    try:
        docs.select("_metadata.file_path")
        return F.col("_metadata.file_path")
    except AnalysisException:
        return F.lit("")


@dataclass(frozen=True)
class Placement:
    """``rows`` with their size, text checksum, number of the old shard, new shard and slot in columns of the given names."""

    rows: DataFrame
    size: str
    crc: str
    old: str
    shard: str
    slot: str
    shards: int
    #: Files that are the old shards, in order; none if the old shards are something else.
    files: list[str]


def reshard(docs: DataFrame, shards: int = 40, old: Column | None = None, capacities: list[int] | None = None) -> Placement:
    """Each row's place. ``capacities`` are shares of the bytes, by default equal.

    ``old`` tells the old shards apart, by default the files; in ascending order they
    are the places of new shards 0, 1 and so on.
    """
    spark = docs.sparkSession
    size, crc, old_, shard, slot, name, block, row, first, part = fresh(docs, "__size", "__crc", "__old", "__shard", "__slot", "__name", "__block", "__row", "__first", "__part")
    base = docs.withColumns({size: row_size(F.col("text")), crc: F.crc32(F.coalesce("text", F.lit(""))), name: F.coalesce(old if old is not None else old_shard(docs), F.lit("")), row: row_index(docs)})
    sized = base.groupBy(name).agg(F.sum(size).alias("size")).orderBy(name).collect()  # as many rows as old shards
    olds, supplies = [r[name] for r in sized], [r["size"] for r in sized]
    # As many rows as old shards: broadcast only while few.
    known = bounded(spark.createDataFrame([(x, i) for i, x in enumerate(olds)], f"`{name}` string, `{old_}` int"))
    base = base.join(known, name).drop(name).withColumn(block, F.pmod(F.xxhash64("doc_id", crc, size, row), F.lit(max(1, BLOCKS // max(1, len(olds))))).cast("int"))
    found = base.groupBy(old_, block).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n")).collect()  # at most BLOCKS rows, or one for each old shard
    blocks = sorted((r[old_], r[block], r["size"]) for r in found)
    total, shares = sum(supplies), capacities or [1] * shards
    edges = [total * sum(shares[: j + 1]) // sum(shares) for j in range(shards)]
    placed = deal_blocks(blocks, plan_transfers(supplies, [b - a for a, b in zip([0, *edges], edges, strict=False)]))
    rows = {(r[old_], r[block]): r["n"] for r in found}
    at, reach, plan = defaultdict(int), defaultdict(int), []
    for i, b, weight in blocks:
        j = placed[i, b]
        plan.append((i, b, j, at[j], reach[j] // PART_BYTES))
        at[j] += rows[i, b]
        reach[j] += weight
    table = bounded(spark.createDataFrame(plan, f"`{old_}` int, `{block}` int, `{shard}` int, `{first}` long, `{part}` long"))
    # The parts' partitioning serves the window too, whose order is that of the slots.
    order = Window.partitionBy(shard, part, old_, block).orderBy("doc_id", crc, size, row)
    out = base.join(table, [old_, block]).repartition(shard, part).withColumn(slot, F.col(first) + F.row_number().over(order) - 1)
    return Placement(out.select(*[F.col(f"`{c}`") for c in docs.columns], size, crc, old_, shard, slot), size, crc, old_, shard, slot, shards, [x for x in olds if x] if old is None else [])


def write_shards(placed: Placement, path: str) -> list[int]:
    """Rewrite the shards that gain or lose rows under ``path``, in slot order, and write the manifest; returns their numbers.

    Files of old shards that stay as they are are named by the manifest and not
    touched; what the other old files hold is all in new ones.
    """
    spark, path = placed.rows.sparkSession, path.rstrip("/")
    moved = placed.rows.where(F.col(placed.old) != F.col(placed.shard)).groupBy(placed.old, placed.shard).count().collect()  # at most old times new shards
    touched = {r[k] for r in moved for k in (0, 1)}
    stays = {j: x for j, x in enumerate(placed.files[: placed.shards]) if j not in touched}
    changed = sorted(set(range(placed.shards)) - set(stays))
    at = f"{path}/shards-{uuid.uuid4().hex}"
    plain = placed.rows.drop(placed.size, placed.crc, placed.old, placed.shard, placed.slot)
    shard, slot = fresh(plain, "shard", "slot")
    hit = placed.rows.where(F.col(placed.shard).isin(changed)).withColumnsRenamed({placed.slot: slot}).withColumn(shard, F.col(placed.shard))
    hit = hit.select(*[F.col(f"`{c}`") for c in plain.columns], slot, shard)
    hit.write.partitionBy(shard).parquet(at)
    replace_file(spark, f"{path}/{MANIFEST}", json.dumps({"written": at, "schema": hit.schema.jsonValue(), "shard": shard, "slot": slot, "stays": stays}))
    return changed


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All rows of written and untouched shards, with their ``shard`` and ``slot`` (the place in the file where untouched)."""
    m = json.loads(read_file(spark, f"{path.rstrip('/')}/{MANIFEST}"))
    out = spark.read.schema(StructType.fromJson(m["schema"])).parquet(m["written"])
    if m["stays"]:
        kept = spark.read.parquet(*m["stays"].values())
        number = F.create_map(*[F.lit(x) for j, file in m["stays"].items() for x in (file, int(j))])
        kept = kept.withColumns({m["slot"]: F.col("_metadata.row_index"), m["shard"]: number[F.col("_metadata.file_path")]})
        out = out.unionByName(kept.select(*[F.col(f"`{c}`") for c in out.columns]))
    return out


def shard_report(docs: DataFrame, path: str, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law of near-equal bytes, read back from the shards written under ``path``."""
    write_shards(reshard(docs, shards), path)
    out = read_shards(docs.sparkSession, path)
    return out.select("doc_id", row_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
