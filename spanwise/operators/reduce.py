"""Aggregation of a track over (overlapping) regions: ten reducers, and the five statistics of the command line."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.reference import Reference
from ..plans.track import Track
from .overlap import clip_to_regions, overlay

REDUCERS = ("sum", "mean", "min", "max", "count", "var", "std", "median", "quantile", "summit")
OPTIONS = {"quantile": {"q", "skipna"}, "var": {"ddof", "skipna"}, "std": {"ddof", "skipna"}, "summit": {"by"}}
STATS = ("mean", "min", "max", "median", "hist")
KEYS = ["region_id", "label"]


def _pieces(track: Track, regions: DataFrame, bucket: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(every region and label with its length, value pieces with base counts, fill included)."""
    cells = regions.select("region_id", (F.col("end") - F.col("start")).alias("length")).crossJoin(F.broadcast(track.label_frame()))
    found = clip_to_regions(track, regions, bucket).select(*KEYS, F.when(~F.isnan(F.col("value").cast("double")), F.col("value")).alias("value"), "lo", "n")
    if track.fill is None:
        return cells, found
    covered = found.groupBy(*KEYS).agg(F.sum("n").alias("covered"))
    rest = cells.join(covered, KEYS, "left").withColumn("n", F.col("length") - F.coalesce("covered", F.lit(0))).where("n > 0")
    kind = track.runs.schema["value"].dataType
    return cells, found.unionByName(rest.select(*KEYS, F.lit(track.fill).cast(kind).alias("value"), F.lit(None).cast("long").alias("lo"), "n"))


#: Bins of a region's distinct values, of about equal numbers of them.
BINS = 64


def at_ranks(have: DataFrame, ranks: list, interpolate: bool = True) -> DataFrame:
    """(region_id, label, total, values): for each of ``ranks`` (functions of the total of bases) the value there, interpolated linearly between whole ranks or the lower one.

    Counts by value are cut into BINS bins of each region and label, whose bounds come
    from a sketch. Running sums over the bins tell which hold the ranks; only those
    bins' values are put in order, so no task holds all values of a region.
    """
    counts = have.groupBy(*KEYS, "value").agg(F.sum("n").alias("n"))
    cuts = counts.groupBy(*KEYS).agg(F.percentile_approx("value", [k / BINS for k in range(1, BINS)], 1000).alias("cuts"))
    binned = counts.join(cuts, KEYS).select(*KEYS, "value", "n", F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("bin"))
    order = Window.partitionBy(*KEYS).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = binned.groupBy(*KEYS, "bin").agg(F.sum("n").alias("m"))
    bins = bins.select(*KEYS, "bin", (F.sum("m").over(order) - F.col("m")).alias("before"), "m", F.sum("m").over(Window.partitionBy(*KEYS)).alias("total"))
    wanted = [(F.floor(r(F.col("total"))), F.ceil(r(F.col("total")))) for r in ranks]
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("m"))
    held = functools.reduce(lambda a, b: a | b, [holds(k) for pair in wanted for k in pair])
    inside = Window.partitionBy(*KEYS, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = binned.join(bins.where(held).select(*KEYS, "bin", "before", "total"), [*KEYS, "bin"])
    rows = rows.withColumns({"before": F.col("before") + F.sum("n").over(inside) - F.col("n"), "m": F.col("n")})
    at = lambda k: F.max(F.when(holds(k), F.col("value")))
    found = rows.groupBy(*KEYS, "total").agg(*[at(k).alias(f"{side}{i}") for i, pair in enumerate(wanted) for side, k in zip(("lo", "hi"), pair, strict=True)])
    part = lambda i: ranks[i](F.col("total")) - wanted[i][0]
    value = lambda i: F.when(part(i) == 0, F.col(f"lo{i}").cast("double")).otherwise((1 - part(i)) * F.col(f"lo{i}") + part(i) * F.col(f"hi{i}"))
    return found.select(*KEYS, "total", F.array(*[value(i) if interpolate else F.col(f"lo{i}") for i in range(len(ranks))]).alias("values"))


def reduce_regions(track: Track, regions: DataFrame, reducer: str, *, q=None, ddof: int | None = None, skipna: bool = True, by=None, bucket: int | None = None, **unknown) -> DataFrame:
    """(region_id, label, value) for each region and label; bases without a value are missing.

    ``sum`` of nothing is 0, ``count`` counts values whatever ``skipna`` says, all
    others of nothing are NULL. With skipna=False a missing base makes the result
    NULL. ``median`` and ``quantile`` interpolate linearly; a list of ``q`` gives a
    row for each. An option that the reducer doesn't take is a TypeError.
    """
    given = {k for k, v in (("q", q), ("ddof", ddof), ("by", by)) if v is not None} | ({"skipna"} if not skipna else set()) | set(unknown)
    if reducer not in REDUCERS:
        raise ValueError(f"unknown reducer {reducer!r}")
    if wrong := given - OPTIONS.get(reducer, {"skipna"}):
        raise TypeError(f"{reducer} does not take {sorted(wrong)}")
    if reducer == "summit":
        raise ValueError("summit reduces several tracks: use summit()")
    if reducer == "quantile":
        wanted = q if isinstance(q, (list, tuple)) else [q]
        if any(x is None or not 0 <= x <= 1 for x in wanted):
            raise ValueError("q must be in [0, 1]")
    if ddof is not None and (isinstance(ddof, bool) or not isinstance(ddof, int) or ddof < 0):
        raise ValueError("ddof must be a non-negative integer")

    cells, pieces = _pieces(track, regions, bucket)
    numeric = pieces.schema["value"].dataType.typeName() not in ("float", "double", "decimal")
    value = F.col("value").cast("long") if numeric else F.col("value")
    have = pieces.where("value IS NOT NULL").withColumn("value", value)
    total, count = F.sum(F.col("value") * F.col("n")), F.sum("n")
    if reducer in ("var", "std"):
        means = have.groupBy(*KEYS).agg(count.alias("count"), (total.cast("double") / count).alias("mean"))
        squares = have.join(means, KEYS).groupBy(*KEYS).agg(F.sum(F.col("n") * (F.col("value") - F.col("mean")) ** 2).alias("squares"), F.first("count").alias("count"))
        left = F.col("count") - (ddof or 0)
        out = F.when(left > 0, F.col("squares") / F.when(left > 0, left))
        found = squares.select(*KEYS, "count", (F.sqrt(out) if reducer == "std" else out).alias("value"))
    elif reducer in ("median", "quantile") and not numeric:
        # Floats may all differ; integers are counted by value in one buffer.
        fractions = [float(x) for x in wanted] if reducer == "quantile" else [0.5]
        found = at_ranks(have, [lambda total, f=f: (total - 1) * F.lit(f) for f in fractions])
        found = found.select(*KEYS, (F.col("values") if reducer == "quantile" else F.col("values")[0]).alias("value"), F.col("total").alias("count"))
    else:
        how = {
            "sum": total, "mean": total.cast("double") / count, "min": F.min("value"), "max": F.max("value"), "count": count,
            "median": F.percentile("value", 0.5, F.col("n")), "quantile": F.percentile("value", [float(x) for x in wanted], F.col("n")) if reducer == "quantile" else None,
        }[reducer]
        found = have.groupBy(*KEYS).agg(how.alias("value"), count.alias("count"))
    out = cells.join(found, KEYS, "left")
    result: Column = F.col("value")
    if reducer in ("sum", "count"):
        result = F.coalesce(result, F.lit(0))
    if not skipna and reducer != "count":
        result = F.when(F.coalesce("count", F.lit(0)) == F.col("length"), result)
    out = out.select("region_id", "ord", "label", result.alias("value"))
    if reducer == "quantile":
        if not isinstance(q, (list, tuple)):
            return out.select("region_id", "ord", "label", F.col("value")[0].alias("value"))
        each = F.array(*[F.struct(F.lit(float(x)).alias("quantile"), F.get("value", F.lit(i)).alias("value")) for i, x in enumerate(q)])
        return out.select("region_id", "ord", "label", F.inline(each))
    return out


def summit(tracks: dict[str, Track], regions: DataFrame, by) -> DataFrame:
    """(region_id, label, summit_position, one column for each track) at the base that is largest by ``by``, lexicographically.

    Ties go to the first base; missing values rank lowest. Bases that no track covers can't be summits
    unless the whole region is uncovered, when its first base is taken.
    """
    by = [by] if isinstance(by, str) else list(by)
    if not by or any(b not in tracks for b in by):
        raise ValueError("by must name tracks")
    first = next(iter(tracks.values()))
    wide = next((t for t in tracks.values() if t.labels != ("",)), first)
    names = list(tracks)
    row = F.struct(*[F.col(n) for n in names])
    joint = Track(overlay({n: t.cover() for n, t in tracks.items()}).select("contig", "start", "end", "label", row.alias("value")), first.reference, wide.labels)
    found = clip_to_regions(joint, regions)
    rank = F.struct(*[F.coalesce(F.col(f"value.{b}").cast("double"), F.lit(float("-inf"))).alias(b) for b in by], (-F.col("lo")).alias("first"))
    best = found.groupBy(*KEYS).agg(F.max_by(F.struct("lo", "value"), rank).alias("best"))
    return best.select(*KEYS, F.col("best.lo").alias("summit_position"), *[F.col(f"best.value.{n}").alias(n) for n in names])


def contig_regions(spark, reference: Reference) -> DataFrame:
    """One region for each contig in order, those of no length included."""
    return reference.frame(spark).select(F.col("contig_ord").cast("long").alias("region_id"), "contig", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))


def stat(track: Track, regions: DataFrame | None, statistic: str) -> DataFrame:
    """The command line's statistics: (region_id, ord, label, value), in region order; of all contigs by default.

    ``median`` is the lower of the two middle values and, like ``hist``, for
    integer and boolean tracks only. ``hist`` counts each base of the union of
    the regions once: (value, label, bases), zero where a label lacks a value.
    """
    if statistic not in STATS:
        raise ValueError(f"unknown statistic {statistic!r}")
    kind = track.runs.schema["value"].dataType.typeName()
    if statistic in ("median", "hist") and kind in ("float", "double"):
        raise TypeError(f"{statistic} needs an integer or boolean track")
    if regions is None:
        regions = contig_regions(track.runs.sparkSession, track.reference)
    if statistic == "hist":
        return histogram(track, regions)
    if statistic == "median":
        return lower_median(track, regions)
    return reduce_regions(track, regions, statistic).orderBy("region_id", "ord")


def lower_median(track: Track, regions: DataFrame) -> DataFrame:
    """The lower of the middle values: percentile_disc over runs."""
    cells, pieces = _pieces(track, regions)
    have = pieces.where("value IS NOT NULL").withColumn("value", F.col("value").cast("long"))
    middle = at_ranks(have, [lambda total: F.floor((total - 1) / 2)], interpolate=False).select(*KEYS, F.col("values")[0].alias("value"))
    return cells.join(middle, KEYS, "left").select("region_id", "ord", "label", "value").orderBy("region_id", "ord")


def histogram(track: Track, regions: DataFrame) -> DataFrame:
    """(value, one column of base counts for each label), values ascending; overlapping regions count once."""
    from .mask import coalesce_intervals

    union = coalesce_intervals(regions).withColumn("region_id", F.concat_ws(":", "contig", "start"))
    _, pieces = _pieces(track, union)
    counts = pieces.where("value IS NOT NULL").groupBy(F.col("value").cast("long").alias("value"), "label").agg(F.sum("n").alias("n"))
    return counts.groupBy("value").agg(*[F.coalesce(F.sum(F.when(F.col("label") == x, F.col("n"))), F.lit(0)).alias(x or "count") for x in track.labels]).orderBy("value")
