"""Algebra of tracks: combinations by position, across columns, by bins and in moving windows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.track import Track
from .overlap import overlay
from .runs import collapse


def combine(tracks: dict[str, Track], value: Column, fill=None) -> Track:
    """A track computed base by base from several, named as columns of ``value``."""
    wide = next((t for t in tracks.values() if t.labels != ("",)), next(iter(tracks.values())))
    runs = overlay(tracks).select("contig", "start", "end", "label", value.alias("value"))
    return replace(wide, runs=collapse(runs, wide.reference.bucket()), fill=fill)


def concat(tracks: list[Track]) -> Track:
    """Columns of several tracks side by side; labels must differ and references agree."""
    labels = tuple(x for t in tracks for x in t.labels)
    if len(set(labels)) < len(labels):
        raise ValueError("labels repeat")
    if any(t.reference != tracks[0].reference or t.fill != tracks[0].fill for t in tracks):
        raise ValueError("tracks differ in reference or fill")
    runs = tracks[0].runs
    for t in tracks[1:]:
        runs = runs.unionByName(t.runs)
    return replace(tracks[0], runs=runs, labels=labels)


def by_label(track: Track, table: DataFrame, value: Column) -> Track:
    """Each run's value computed with a row of ``table`` (label, ...), one row for each label: a broadcast join."""
    return replace(track, runs=track.runs.join(F.broadcast(table), "label").select("contig", "start", "end", "label", value.alias("value")), fill=None)


def thresholds(track: Track, levels: list) -> DataFrame:
    """(contig, start, end, label, threshold, value): value >= threshold on a new axis."""
    levels_ = track.runs.sparkSession.createDataFrame([(x,) for x in levels], "threshold double")
    return track.runs.crossJoin(F.broadcast(levels_)).withColumn("value", F.col("value") >= F.col("threshold"))


def across_labels(track: Track, **aggregates: Column) -> DataFrame:
    """(contig, start, end, one column for each aggregate of ``value``) over all labels of each base that any run covers, fill included."""
    bucket = track.reference.bucket()
    # One scan whatever the number of labels: break points of any label cut all, within buckets.
    cut = track.split(bucket).select("contig", "bucket", "label", "value", F.col("start").alias("lo"), F.col("end").alias("hi"))
    marks = cut.select("contig", "bucket", F.explode(F.array("lo", "hi")).alias("start")).distinct()
    ends = F.lead("start").over(Window.partitionBy("contig", "bucket").orderBy("start"))
    segments = marks.withColumn("end", ends).where("end IS NOT NULL").crossJoin(F.broadcast(track.label_frame().select("label"))).alias("s")
    same = [F.col(f"s.{k}") == F.col(f"c.{k}") for k in ("contig", "bucket", "label")]
    met = segments.join(cut.alias("c"), [*same, F.col("lo") <= F.col("s.start"), F.col("s.start") < F.col("hi")], "left")
    filled = F.when(F.col("lo").isNotNull(), F.col("value")).otherwise(F.lit(track.fill).cast(track.runs.schema["value"].dataType))
    met = met.select("s.contig", "s.start", "s.end", filled.alias("value"), F.col("lo").isNotNull().alias("__held"))
    found = met.groupBy("contig", "start", "end").agg(*[a.alias(n) for n, a in aggregates.items()], F.max("__held").alias("__held")).where("__held")
    return collapse(found.drop("__held"), bucket, ("contig",), tuple(aggregates))


def binned(track: Track, width: int, aggregate: str = "mean") -> DataFrame:
    """(contig, bin, label, value) over bins that restart in each contig; the last may be short."""
    cut = replace(track.cover(), reference=track.reference).split(width)
    n, v = F.col("end") - F.col("start"), F.col("value")
    known = F.sum(F.when(v.isNotNull(), n))
    how = {"mean": F.sum(v * n).cast("double") / known, "sum": F.coalesce(F.sum(v * n), F.lit(0)), "min": F.min(v), "max": F.max(v), "count": F.coalesce(known, F.lit(0))}[aggregate]
    return cut.groupBy("contig", F.col("bucket").alias("bin"), "label").agg(how.alias("value"))


def rolling_mean(track: Track, width: int, center: bool = True, block: int = 65_536) -> DataFrame:
    """(contig, pos, label, value): mean of ``width`` bases about each, NULL where the window leaves the contig or holds a missing base.

    Blocks of each contig carry the neighbours that their windows reach, so no
    contig is one task.
    """
    before = width // 2 if center else width - 1
    after = width - 1 - before
    dense = track.cover().dense()
    first, last = F.floor((F.col("pos") - after) / block), F.floor((F.col("pos") + before) / block)
    spread = dense.withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    order = Window.partitionBy("contig", "label", "block").orderBy("pos").rowsBetween(-before, after)
    seen = spread.select("contig", "pos", "label", "block", F.avg("value").over(order).alias("mean"), F.count("value").over(order).alias("n"))
    own = seen.where(F.floor(F.col("pos") / block) == F.col("block"))
    return own.select("contig", "pos", "label", F.when(F.col("n") == width, F.col("mean")).alias("value"))


def label_totals(track: Track) -> DataFrame:
    """(label, total, bases, mean): of each column over the whole reference, fill included."""
    n, v = F.col("end") - F.col("start"), F.col("value")
    kept = track.cover().runs.groupBy("label").agg(F.coalesce(F.sum(v * n), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)).alias("bases"))
    return kept.withColumn("mean", F.try_divide(F.col("total").cast("double"), F.col("bases")))
