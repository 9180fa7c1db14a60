"""Run-length collapse, and the text export of several columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grammar import format_g, quantize
from ..plans.track import Track
from .overlap import clip_to_regions


def _merge(runs: DataFrame, keys: list[str], values: tuple[str, ...], **more) -> DataFrame:
    """Merge runs of equal keys that touch and agree in every value."""
    order = Window.partitionBy(*keys).orderBy("start")
    state = F.struct(F.lit(0).alias("any"), *[F.col(f"`{v}`").alias(v) for v in values])
    fresh = ~(F.lag("end").over(order).eqNullSafe(F.col("start")) & F.lag(state).over(order).eqNullSafe(state))
    marked = runs.withColumn("__run", fresh.cast("int")).withColumn("__run", F.sum("__run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumns({n: c(F.col("__run")).over(Window.partitionBy(*keys)) for n, c in more.items()})
    return marked.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.first(f"`{v}`").alias(v) for v in values], *[F.first(n).alias(n) for n in more])


def collapse(runs: DataFrame, bucket: int, keys: tuple[str, ...] = ("contig", "label"), values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Merge runs, none of which overlap, that touch and agree in every value (NULL agrees with NULL).

    Runs merge within the bucket that they start in. Then only a bucket's first and last
    ones can go on in others: at most two for each key and bucket meet in one window,
    while the rest keep windows of their own.
    """
    inner = _merge(runs.withColumn("__bucket", F.floor(F.col("start") / bucket)), [*keys, "__bucket"], values, __last=F.max)
    edge = (F.col("__run") == 1) | (F.col("__run") == F.col("__last"))
    merged = _merge(inner.withColumn("__bucket", F.when(edge, -1).otherwise(F.col("__bucket"))).drop("__run"), [*keys, "__bucket"], values)
    return merged.select(*[k for k in keys if k != "label"], "start", "end", *[k for k in keys if k == "label"], *[F.col(f"`{v}`") for v in values])


def view(track: Track, regions: DataFrame, columns=None, digits: int | None = None) -> DataFrame:
    """(region_id, contig, start, end, one column for each label): runs on which every column agrees, in each region.

    Bases where all columns are missing are left out. Runs never cross region
    bounds. ``digits`` rounds floats to significant digits before runs are compared.
    """
    track = (track.select(columns) if columns else track).cover()
    names = [x or "value" for x in track.labels]
    bucket = track.reference.bucket()
    pieces = clip_to_regions(track, regions, bucket)
    kind = track.runs.schema["value"].dataType
    rounds = digits and kind.typeName() in ("float", "double")
    value = quantize(F.col("value"), digits).cast(kind) if rounds else F.col("value")
    cut = pieces.select("region_id", "bucket", "label", value.alias("value"), "lo", (F.col("lo") + F.col("n")).alias("hi"))
    # Break points of any column cut all of them; last() carries each column's state on. Each bucket starts with all states.
    on = cut.select("region_id", "bucket", F.col("lo").alias("pos"), "label", F.struct("value").alias("s"))
    ends = cut.groupBy("region_id", "bucket").agg(F.max("hi").alias("pos")).select("region_id", "bucket", "pos", F.lit(None).cast("string").alias("label"), F.lit(None).cast(on.schema["s"].dataType).alias("s"))
    wide = on.unionByName(ends).groupBy("region_id", "bucket", "pos").agg(*[F.max(F.when(F.col("label") == x, F.col("s"))).alias(n) for x, n in zip(track.labels, names, strict=True)])
    order = Window.partitionBy("region_id", "bucket").orderBy("pos")
    states = [F.last(f"`{n}`", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).getField("value").alias(n) for n in names]
    segments = wide.select("region_id", F.col("pos").alias("start"), F.lead("pos").over(order).alias("end"), *states).where("end IS NOT NULL")
    some = segments.where(F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names]).isNotNull())
    merged = collapse(some, bucket, ("region_id",), tuple(names))
    return merged.join(F.broadcast(regions.select("region_id", "contig")) if regions.isLocal() else regions.select("region_id", "contig"), "region_id").select("region_id", "contig", "start", "end", *[F.col(f"`{n}`") for n in names])


def view_lines(runs: DataFrame, digits: int = 6) -> DataFrame:
    """One text line for each row of view(), in order; missing prints NaN, booleans 1 and 0, floats %g."""
    names = [c for c in runs.columns if c not in ("region_id", "contig", "start", "end")]
    kinds = dict(runs.dtypes)

    @F.pandas_udf("string")
    def as_g(v):
        return v.map(lambda x: format_g(x, digits))

    def cell(n: str):
        if kinds[n] in ("float", "double"):
            return as_g(F.col(n).cast("double"))
        plain = F.col(n).cast("int") if kinds[n] == "boolean" else F.col(n)
        return F.coalesce(plain.cast("string"), F.lit("NaN"))

    line = F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), *[cell(n) for n in names])
    return runs.select("region_id", "start", line.alias("value")).orderBy("region_id", "start")


def write_view(runs: DataFrame, path: str, compressed: bool = False) -> None:
    """Write view() as a folder of text files that are in order, the first with the header line."""
    names = [c for c in runs.columns if c not in ("region_id", "contig", "start", "end")]
    spark = runs.sparkSession
    head = spark.createDataFrame([(-1, -1, "\t".join(["#chrom", "start", "end", *names]))], "region_id long, start long, value string")
    lines = head.unionByName(view_lines(runs)).orderBy("region_id", "start").select("value")
    lines.write.mode("errorifexists").option("compression", "gzip" if compressed else "none").text(path)
