"""The Python surface: open, create, write, region, reduce_regions, interval_mask and the importers.

``append`` lives on Store; extension points are plain Spark ones (pandas UDFs, Python data sources).
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.grammar import RegionQuery, parse_region
from .operators import mask, pileup, reduce
from .plans.reference import Reference
from .plans.track import Track, as_regions
from .sources import store as stores
from .sources import text
from .sources.binary import read_bam, read_bigwig
from .sources.store import StoreError, open_zip, pack

__all__ = ["Reference", "RegionQuery", "StoreError", "cancel", "create", "import_bam", "import_bed", "import_bigwig", "interval_mask", "job", "open", "open_zip", "pack", "parse_region", "reduce_regions", "region", "select_loci", "write"]

open = stores.open_store  # noqa: A001
create = stores.create
region = mask.region
select_loci = mask.select_loci


def write(store: stores.Store, tracks: dict[str, Track], **layout) -> None:
    """Add derived tracks to a store that is open for writing; ``layout`` as in Store.write()."""
    store.write(tracks, **layout)


@contextmanager
def job(spark: SparkSession, name: str):
    """Everything this thread runs within can be ended by cancel(); a store that was being written keeps nothing of it."""
    context = spark.sparkContext
    context.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, name: str) -> None:
    spark.sparkContext.cancelJobGroup(name)


def reduce_regions(tracks: Track | dict[str, Track], intervals, reducer: str, **options):
    """Reduce one track, or several for ``summit``, over intervals in any accepted form."""
    first = tracks if isinstance(tracks, Track) else next(iter(tracks.values()))
    regions = as_regions(first.runs.sparkSession, intervals, first.reference)
    if reducer == "summit":
        by = options.pop("by", None)
        if options or by is None:
            raise TypeError("summit takes by=")
        return reduce.summit({by: tracks} if isinstance(tracks, Track) else tracks, regions, by)
    if isinstance(tracks, Track):
        return reduce.reduce_regions(tracks, regions, reducer, **options)
    out = None
    for name, t in tracks.items():
        part = reduce.reduce_regions(t, regions, reducer, **options).withColumn("track", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def interval_mask(spark: SparkSession, intervals, reference: Reference) -> Track:
    return mask.interval_mask(as_regions(spark, intervals, reference), reference)


def labels_of(pairs: list[tuple[str, str | None]]) -> list[str]:
    """Labels of (path, label) sources: all given or none, when file names give them; none may repeat."""
    if len({x is None for _, x in pairs}) > 1:
        raise ValueError("either all sources or none have labels")
    found = [x or text.default_label(p) for p, x in pairs]
    if len(set(found)) < len(found):
        raise ValueError("labels repeat")
    return found


def _labelled(sources, labels=None) -> list[tuple[str, str]]:
    sources = [sources] if isinstance(sources, str) else list(sources)
    if labels is not None:
        return list(zip(sources, labels_of(list(zip(sources, labels, strict=True))), strict=True))
    pairs = [text.parse_source(s) for s in sources]
    return list(zip([p for p, _ in pairs], labels_of(pairs), strict=True))


def import_bed(store: stores.Store, sources, schema=None, fill=text.UNSET, labels=None, **options) -> None:
    """BED files as columns of the tracks that their value columns name (``mask`` for BED3); ``options`` as in text.import_bed()."""
    store.write(text.import_bed(store.spark, _labelled(sources, labels), store.reference, schema, fill, **options))


def import_bigwig(store: stores.Store, sources, track: str = "signal", fill=None, labels=None) -> None:
    """bigWig files as columns of one float track; uncovered bases are ``fill`` (missing by default)."""
    parts, named = None, _labelled(sources, labels)
    for path, label in named:
        reference, runs = read_bigwig(store.spark, path, label)
        if reference != store.reference:
            raise ValueError(f"{path} has another reference")
        parts = runs if parts is None else parts.unionByName(runs)
    store.write({track: Track(parts, store.reference, tuple(x for _, x in named), fill)})


def import_bam(store: stores.Store, sources, track: str = "depth", options: pileup.PileupOptions = pileup.PileupOptions(), labels=None, fields=("depth",), axis: str = "track") -> None:
    """BAM or SAM files: their depth as columns of one track, or counts of ``fields``.

    Several fields make a track each (named by the field) with a column for each file, or,
    for ``axis`` column, one track of a single file with a column for each field.
    """
    named, fields = _labelled(sources, labels), tuple(fields)
    if not fields or len(set(fields)) < len(fields) or set(fields) - set(pileup.FIELDS):
        raise ValueError(f"fields are some of {pileup.FIELDS}, each once")
    if axis not in ("track", "column"):
        raise ValueError(f"unknown axis {axis!r}")
    if axis == "column" and len(named) > 1:
        raise ValueError("either files or fields are a track's columns")
    parts: dict[str, object] = {}
    for path, label in named:
        reference, reads = (text.read_sam if path.endswith(".sam") else read_bam)(store.spark, path, label)
        if reference != store.reference:
            raise ValueError(f"{path} has another reference")
        if fields == ("depth",):
            found = {track: pileup.depth(reads, reference, options, (label,)).runs.withColumn("value", F.col("value").cast("int"))}
        else:
            found = {f: pileup.field_track(reads, reference, f, options, (label,)).runs for f in fields}
        for name, runs in found.items():
            runs = runs.withColumn("label", F.lit(name)) if axis == "column" else runs
            key = track if axis == "column" else name
            parts[key] = runs if key not in parts else parts[key].unionByName(runs)
    columns = fields if axis == "column" else tuple(x for _, x in named)
    store.write({n: Track(runs, store.reference, columns, 0, "field" if axis == "column" else "sample") for n, runs in parts.items()})
