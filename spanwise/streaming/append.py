"""Appending arriving interval files to a store's track with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.track import Track
from ..sources.store import open_store

SCHEMA = "contig string, start long, end long, label string, value double"


def watch_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of run files (Parquet, columns of SCHEMA) that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def append_stream(runs: DataFrame, store_path: str, track: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's rows join ``track``; labels that aren't there become new columns, wherever a label's rows arrive.

    The store's metadata keeps the number of the last batch of this checkpoint, in the
    same step that makes its rows count: a replayed batch does nothing. A base that
    arrives again, in a later batch, has its later value.
    """

    def add(batch: DataFrame, number: int) -> None:
        store = open_store(batch.sparkSession, store_path, read_only=False)
        known = store.meta["tracks"][track]
        labels = sorted(r.label for r in batch.select("label").distinct().collect())  # as many as columns
        if labels:
            typed = batch.withColumn("value", F.col("value").cast(known["dtype"]))
            store.append(track, Track(typed, store.reference, tuple(labels), known["fill"], known["dim"]), (checkpoint, number))

    return runs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
