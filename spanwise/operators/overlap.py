"""Range joins and overlays by buckets: equi-joins and windows that no contig's length can overload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.track import Track


def clip_to_regions(track: Track, regions: DataFrame, bucket: int | None = None) -> DataFrame:
    """(region_id, bucket, label, value, lo, n): each run cut to each region it meets.

    Both sides are cut at bucket bounds and joined on (contig, bucket), so each
    base counts once for each region, and long runs or regions spread over tasks.
    """
    bucket = bucket or track.reference.bucket()
    asked = regions.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))
    asked = asked.select("region_id", "contig", "bucket", F.greatest("start", F.col("bucket") * bucket).alias("r_start"), F.least("end", (F.col("bucket") + 1) * bucket).alias("r_end"))
    met = track.split(bucket).join(asked, ["contig", "bucket"]).where("start < r_end AND r_start < end")
    lo, hi = F.greatest("start", "r_start"), F.least("end", "r_end")
    return met.select("region_id", "bucket", "label", "value", lo.alias("lo"), (hi - lo).alias("n"))


def overlay(tracks: dict[str, Track]) -> DataFrame:
    """(contig, start, end, label, one column for each track): segments on which all tracks are constant.

    Tracks must have the same reference; a track of the one label '' meets every
    label of the others. Bases that no run covers anywhere are left out; elsewhere
    an uncovered track has its fill.
    """
    first = next(iter(tracks.values()))
    if any(t.reference != first.reference for t in tracks.values()):
        raise ValueError("tracks of different references can't be combined")
    wide = next((t for t in tracks.values() if t.labels != ("",)), first)
    bucket, events = first.reference.bucket(), None
    for name, t in tracks.items():
        if t.labels not in (("",), wide.labels):
            raise ValueError("tracks of different labels can't be combined")
        runs = t.split(bucket)
        if t.labels == ("",) and wide.labels != ("",):
            runs = runs.drop("label").crossJoin(F.broadcast(wide.label_frame().select("label")))
        on = runs.select("contig", "bucket", "label", F.col("start").alias("pos"), F.struct(F.lit(True).alias("on"), F.col("value").alias("v")).alias(name))
        off = runs.select("contig", "bucket", "label", F.col("end").alias("pos"), F.struct(F.lit(False).alias("on"), F.lit(None).cast(t.runs.schema["value"].dataType).alias("v")).alias(name))
        part = on.unionByName(off)
        events = part if events is None else events.unionByName(part, allowMissingColumns=True)
    # A run may start where another ends: "on" is the larger of the two.
    marks = events.groupBy("contig", "bucket", "label", "pos").agg(*[F.max(n).alias(n) for n in tracks])
    order = Window.partitionBy("contig", "bucket", "label").orderBy("pos")
    state = {n: F.last(n, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for n in tracks}
    cut = marks.select("contig", "label", F.col("pos").alias("start"), F.lead("pos").over(order).alias("end"), *[s.alias(n) for n, s in state.items()])
    live = cut.where(F.col("end").isNotNull() & F.greatest(*[F.coalesce(F.col(f"{n}.on"), F.lit(False)) for n in tracks], F.lit(False)))
    value: dict[str, Column] = {}
    for n, t in tracks.items():
        value[n] = F.when(F.coalesce(F.col(f"{n}.on"), F.lit(False)), F.col(f"{n}.v")).otherwise(F.lit(t.fill).cast(t.runs.schema["value"].dataType))
    return live.select("contig", "start", "end", "label", *[v.alias(n) for n, v in value.items()])
