"""Interval sets: union, masks, set algebra, region slices and locus joins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grammar import RegionQuery, parse_region
from ..plans.reference import Reference, bin_width
from ..plans.track import Track
from .overlap import overlay
from .runs import collapse


def coalesce_intervals(regions: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """(contig, start, end): the union of intervals; touching ones merge.

    Intervals are cut at bucket bounds and merged within buckets; what touches a bound
    merges then, as runs do.
    """
    cut = regions.where("start < end").select("contig", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))).alias("bucket"))
    cut = cut.withColumns({"start": F.greatest("start", F.col("bucket") * bucket), "end": F.least("end", (F.col("bucket") + 1) * bucket)})
    order = Window.partitionBy("contig", "bucket").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = cut.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    island = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = island.groupBy("contig", "bucket", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return collapse(pieces.select("contig", "start", "end"), bucket, ("contig",), ())


def interval_mask(regions: DataFrame, reference: Reference) -> Track:
    """A boolean track: true on the union of the intervals, false elsewhere."""
    return Track(coalesce_intervals(regions, reference.bucket()).select("contig", "start", "end", F.lit("").alias("label"), F.lit(True).alias("value")), reference, fill=False)


def combine_masks(a: Track, b: Track, how: str) -> DataFrame:
    """(contig, start, end) of a and b, a or b, or a and not b, as merged intervals."""
    test = {"and": F.col("a") & F.col("b"), "or": F.col("a") | F.col("b"), "andnot": F.col("a") & ~F.col("b")}[how]
    return coalesce_intervals(overlay({"a": a, "b": b}).where(test).select("contig", "start", "end"), a.reference.bucket())


def region(track: Track, query, dim: str = "position") -> DataFrame:
    """(contig, pos, position, label, value): the bases of one region, fill included; of bins if ``dim`` is bin_N.

    ``position`` is the text contig:pos. The range reaches the scan as literal filters.
    """
    query = parse_region(query, track.reference.names) if isinstance(query, str) else query
    if not isinstance(query, RegionQuery):
        query = RegionQuery(*query)
    contig, start, end = track.reference.resolve(query.contig, query.start, query.end)
    width = bin_width(dim) or 1
    start, end = start // width * width, min(-(-end // width) * width, track.reference[contig])
    near = track.runs.where((F.col("contig") == contig) & (F.col("start") < end) & (F.col("end") > start))
    cut = near.withColumns({"start": F.greatest("start", F.lit(start)), "end": F.least("end", F.lit(end))})
    found = replace(track, runs=cut).dense()
    spark = track.runs.sparkSession
    every = spark.range(start, end, width).select(F.col("id").alias("pos")).crossJoin(F.broadcast(track.label_frame()))
    held = found.select("pos", "label", "value", F.lit(True).alias("held"))
    value = F.when(F.col("held"), F.col("value")).otherwise(F.lit(track.fill).cast(track.runs.schema["value"].dataType))
    out = every.join(held, ["pos", "label"], "left")
    return out.select(F.lit(contig).alias("contig"), "pos", F.concat_ws(":", F.lit(contig), "pos").alias("position"), "ord", "label", value.alias("value"))


def align_loci(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join two region() views of one contig by position and label; views of different contigs are an error."""
    contigs = {r.contig for v in (a, b) for r in v.select("contig").distinct().limit(2).collect()}
    if len(contigs) > 1:
        raise ValueError("views of different contigs can't be aligned")
    if how not in ("inner", "outer", "left", "right"):
        raise ValueError(f"unknown join {how!r}")
    left, right = (v.select("contig", "pos", "label", F.col("value").alias(n)) for v, n in ((a, "left_value"), (b, "right_value")))
    return left.join(right, ["contig", "pos", "label"], how)


def where(track: Track, mask: Track, other=None) -> Track:
    """The track where the mask is true; ``other`` (missing by default) elsewhere."""
    both = overlay({"t": track.cover(), "m": mask.cover()})
    kind = track.runs.schema["value"].dataType
    value = F.when(F.col("m"), F.col("t")).otherwise(F.lit(other).cast(kind))
    return replace(track, runs=collapse(both.select("contig", "start", "end", "label", value.alias("value")), track.reference.bucket()), fill=other)


def select_loci(view: DataFrame, labels) -> DataFrame:
    """Rows of a region() view by their texts contig:pos: one, a list (in its order), or a slice, which holds its stop too.

    A label of another contig, or one that the view doesn't hold, is a KeyError.
    """
    ends = view.agg(F.first("contig").alias("contig"), F.min("pos").alias("low"), F.max("pos").alias("high")).first()

    def position(label: str) -> int:
        contig, _, pos = str(label).rpartition(":")
        if contig != ends.contig:
            raise KeyError(f"{label!r} is not on {ends.contig!r}")
        if not pos.isdigit() or not ends.low <= int(pos) <= ends.high:
            raise KeyError(f"{label!r} is not in this locus")
        return int(pos)

    if isinstance(labels, slice):
        if labels.step is not None:
            raise NotImplementedError("label slices take no step")
        low = ends.low if labels.start is None else position(labels.start)
        high = ends.high if labels.stop is None else position(labels.stop)
        return view.where(F.col("pos").between(low, high))
    wanted = [position(x) for x in ([labels] if isinstance(labels, str) else labels)]
    table = view.sparkSession.createDataFrame(list(enumerate(wanted)), "place long, pos long")
    return view.join(F.broadcast(table), "pos").orderBy("place", "ord").select(*view.columns)

