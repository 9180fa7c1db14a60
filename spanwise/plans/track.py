"""Tracks as runs: half-open ranges of one value for each label, over a reference."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grammar import RegionQuery, parse_region
from .reference import Reference


@dataclass(frozen=True)
class Track:
    """Runs (contig, start, end, label, value), not overlapping within a label. NULL is missing, and so is NaN: it becomes NULL here.

    ``fill`` is the value of bases that no run covers (None: missing). ``labels``
    are in stored order; a track without a column axis has the one label ''.
    """

    runs: DataFrame
    reference: Reference
    labels: tuple[str, ...] = ("",)
    fill: float | int | bool | None = None
    dim: str = "sample"

    def __post_init__(self):
        if self.runs.schema["value"].dataType.typeName() in ("float", "double") and not hasattr(self.runs, "_without_nan"):
            runs = self.runs.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
            runs._without_nan = True
            object.__setattr__(self, "runs", runs)
        if isinstance(self.fill, float) and self.fill != self.fill:
            object.__setattr__(self, "fill", None)

    def select(self, labels: Iterable[str]) -> Track:
        """Columns by label, in the requested order; an unknown label is an error."""
        labels = tuple(labels)
        unknown = [x for x in labels if x not in self.labels]
        if unknown:
            raise ValueError(f"unknown {self.dim} {unknown}; there are {list(self.labels)}")
        return replace(self, runs=self.runs.where(F.col("label").isin(*labels)), labels=labels)

    def label_frame(self) -> DataFrame:
        """(ord, label): as many rows as labels, safe to broadcast."""
        return self.runs.sparkSession.createDataFrame(list(enumerate(self.labels)), "ord int, label string")

    def map(self, value: Column, fill) -> Track:
        """Each run's value replaced; ``fill`` is what the old fill becomes."""
        return replace(self, runs=self.runs.withColumn("value", value), fill=fill)

    def split(self, bucket: int) -> DataFrame:
        """Runs cut at bucket bounds, with their bucket: states need not cross buckets, so long contigs spread out."""
        at = F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket)))
        cut = self.runs.where("start < end").withColumn("bucket", at)
        return cut.withColumns({"start": F.greatest("start", F.col("bucket") * bucket), "end": F.least("end", (F.col("bucket") + 1) * bucket)})

    def cover(self) -> Track:
        """Runs plus the fill of every uncovered base, so that each label's runs cover the reference."""
        spark, bucket = self.runs.sparkSession, self.reference.bucket()
        cells = spark.createDataFrame([(n, x) for n, x in self.reference.items() if x], "contig string, length long")
        cells = cells.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / bucket)))).crossJoin(F.broadcast(self.label_frame().select("label")))
        edge = cells.select("contig", "label", "bucket", (F.col("bucket") * bucket).alias("start"), (F.col("bucket") * bucket).alias("end"), F.lit(True).alias("edge"))
        stop = cells.select("contig", "label", "bucket", F.least("length", (F.col("bucket") + 1) * bucket).alias("start"), F.least("length", (F.col("bucket") + 1) * bucket).alias("end"), F.lit(True).alias("edge"))
        cut = self.split(bucket).select("contig", "label", "bucket", "start", "end", F.lit(False).alias("edge"))
        order = Window.partitionBy("contig", "label", "bucket").orderBy("start", "end")
        gaps = edge.unionByName(stop).unionByName(cut).withColumn("next", F.lead("start").over(order)).where("next > end")
        kind = self.runs.schema["value"].dataType
        filler = gaps.select("contig", F.col("end").alias("start"), F.col("next").alias("end"), "label", F.lit(self.fill).cast(kind).alias("value"))
        return replace(self, runs=self.runs.select("contig", "start", "end", "label", "value").unionByName(filler))

    def dense(self) -> DataFrame:
        """(contig, pos, label, value) of each covered base."""
        return self.runs.select("contig", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), "label", "value")


def points_track(points: DataFrame, reference: Reference, labels: tuple[str, ...] = ("",), fill=None) -> Track:
    """A track from (contig, pos, label, value) rows, one for each base and label."""
    return Track(points.select("contig", F.col("pos").cast("long").alias("start"), (F.col("pos") + 1).cast("long").alias("end"), "label", "value"), reference, labels, fill)


def as_regions(spark: SparkSession, regions, reference: Reference) -> DataFrame:
    """(region_id, contig, start, end) in input order, duplicates kept.

    Takes a region text, a RegionQuery, a (contig, start, end) tuple, a list of
    those, three arrays, or a DataFrame that gives its rows in one order each time or has a region_id (Spark's or pandas') with one of contig, chrom, #chrom and start and
    end. Ranges outside of their contig raise; nothing is clipped.
    """
    if isinstance(regions, DataFrame):
        name = [c for c in ("contig", "chrom", "#chrom") if c in regions.columns]
        if len(name) != 1:
            raise ValueError("regions need exactly one of contig, chrom, #chrom")
        ids = F.col("region_id") if "region_id" in regions.columns else F.monotonically_increasing_id()
        rows = regions.select(ids.alias("region_id"), F.col(f"`{name[0]}`").alias("contig"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        known = F.broadcast(reference.frame(spark).select("contig", "length"))
        checked = rows.join(known, "contig", "left")
        wrong = F.concat(F.lit("region outside of the reference: "), F.concat_ws(" ", "contig", F.col("start").cast("string"), F.col("end").cast("string")))
        fine = F.col("length").isNotNull() & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("length"))
        return checked.select("region_id", "contig", F.when(F.coalesce(fine, F.lit(False)), F.col("start")).otherwise(F.raise_error(wrong).cast("long")).alias("start"), "end")
    if hasattr(regions, "itertuples"):
        name = [c for c in ("contig", "chrom", "#chrom") if c in regions.columns]
        if len(name) != 1:
            raise ValueError("regions need exactly one of contig, chrom, #chrom")
        regions = list(zip(regions[name[0]].tolist(), regions["start"].tolist(), regions["end"].tolist(), strict=True))
    if isinstance(regions, (str, RegionQuery)) or (isinstance(regions, tuple) and len(regions) == 3 and isinstance(regions[0], str)):
        regions = [regions]
    elif isinstance(regions, tuple) and len(regions) == 3:
        regions = list(zip(*(list(x) for x in regions), strict=True))
    rows = []
    for x in regions:
        if isinstance(x, str):
            x = parse_region(x, reference.names)
        contig, start, end = (x.contig, x.start, x.end) if isinstance(x, RegionQuery) else x
        if any(v is not None and (isinstance(v, (bool, float)) or int(v) != v) for v in (start, end)):
            raise TypeError("positions must be integers")
        rows.append((len(rows), *reference.resolve(contig, None if start is None else int(start), None if end is None else int(end))))
    if not rows:
        raise ValueError("no regions")
    return spark.createDataFrame(rows, "region_id long, contig string, start long, end long")
