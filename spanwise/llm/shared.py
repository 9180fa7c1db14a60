"""Shared folder for intermediate tables, and column helpers used by several operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import delete

#: Folds of the hold-out rule: crc32(doc_id as text) mod FOLDS; remainder 0 is held out.
FOLDS = 5
#: Rows of ids up to which a counted table is broadcast (some 20 MB in memory).
BROADCAST_ROWS = 300_000
#: Rows of an Arrow batch at most.
BATCH_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder is set for a local session, whose driver
    and executors are one machine; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spanwise-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches to Python hold BATCH_ROWS rows at most: texts are long, and every copy of a batch costs both sides memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever its columns are called."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Deletes the tables that stage_table() wrote within it at its end, but for the kept ones.

    The results of operators read staged tables lazily, so write or collect them inside.
    """

    open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, set()

    def __enter__(self) -> Scratch:
        Scratch.open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.discard(df._staged_at)
        return df

    def __exit__(self, *_) -> None:
        Scratch.open.remove(self)
        for path in self.paths:
            delete(self.spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which an open Scratch will delete."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if Scratch.open:
        Scratch.open[-1].paths.add(path)
    return path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a table of stage_table() that nothing will read again."""
    delete(df.sparkSession, df._staged_at)


def row_index(df: DataFrame) -> Column:
    """A row's number in its file, which tells apart equal rows of tables read from Parquet; 0 for other tables."""
    try:
        df.select("_metadata.row_index")
        return F.col("_metadata.row_index")
    except AnalysisException:
        return F.lit(0).cast("long")


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if its counted rows are at most ``limit``; else the planner's shuffled join stands.

    ``df`` should be a staged table of a few narrow columns.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id's text is divisible by FOLDS (a null doc_id counts as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0)) == 0


def labelled_sample(labels: DataFrame, label: str, limit: int, key: str = "doc_id") -> DataFrame:
    """At most ``limit`` labelled training rows in hash order: (doc_id, label). Bounded, so it may be broadcast.

    A row of the held-out fold, or whose id or label is null, is never taken; equal
    rows count once.
    """
    ready = labels.select(F.col(key).alias("doc_id"), F.col(label).alias("label"))
    ready = ready.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    return ready.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
