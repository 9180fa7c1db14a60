"""Command line: view, stat, import, append, info, validate."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import api
from .functions.grammar import DEFAULT_EXCLUDE, format_g, parse_flags
from .operators import pileup, reduce, runs
from .plans.reference import Reference
from .plans.track import as_regions
from .sources import files, text
from .sources import store as stores
from .sources.binary import BgzfWriter


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanwise")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("view", "stat"):
        c = sub.add_parser(name)
        c.add_argument("store")
        c.add_argument("--track", "-t")
        c.add_argument("--columns", "-c", help="labels, comma-separated, in output order")
        c.add_argument("--region", "-r", action="append", default=[])
        c.add_argument("--regions-file", "--regions", "-R")
        c.add_argument("--digits", "--precision", "-p", type=int, default=6)
        c.add_argument("--output", "-o", help="file to write; .gz is written as BGZF")
        c.add_argument("--no-header", action="store_true")
        if name == "stat":
            c.add_argument("--statistic", "-s", choices=reduce.STATS, default="mean")
    for name in ("import", "append"):
        c = sub.add_parser(name)
        c.add_argument("kind", choices=["bed", "bigwig", "bam"])
        c.add_argument("store")
        c.add_argument("sources", nargs="*", help="PATH[:LABEL]")
        c.add_argument("--file-list", "-f", help="sources, one a line: PATH or PATH<TAB>LABEL")
        c.add_argument("--track", default=None)
        c.add_argument("--reference", "--genome", help="FAI or chrom.sizes, for a new store")
        c.add_argument("--dim", default="sample")
        c.add_argument("--field", action="append", help="a value column by its header name; repeat for more")
        c.add_argument("--schema", help="TSV of columns, tracks, types and fills")
        c.add_argument("--emit-schema", action="store_true", help="print the schema of the sources, and import nothing")
        c.add_argument("--dtype", choices=list(text.SPARK_TYPES))
        c.add_argument("--fill")
        c.add_argument("--infer-rows", default=str(text.SAMPLE), help="records that types are inferred from, or all")
        c.add_argument("--composition", action="store_true", help="a track for each kind of count")
        c.add_argument("--min-mapq", type=int, default=0)
        c.add_argument("--min-bq", type=int, default=0)
        c.add_argument("--exclude", default=str(DEFAULT_EXCLUDE))
        c.add_argument("--count-deletions", action="store_true")
        c.add_argument("--mates", choices=pileup.MATES, default="proper")
    c = sub.add_parser("info")
    c.add_argument("store")
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("validate")
    c.add_argument("store")
    return p


def _regions(spark: SparkSession, args, reference: Reference):
    """-r regions in the given order, then those of the file; None without any."""
    asked = as_regions(spark, args.region, reference) if args.region else None
    if args.regions_file:
        listed = text.read_regions(spark, args.regions_file, reference)
        shifted = listed.selectExpr(f"region_id + {len(args.region)} AS region_id", "contig", "start", "end")
        asked = shifted if asked is None else asked.unionByName(shifted)
    return asked


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    out = sys.stdout.write
    if args.command == "validate":
        status, found = stores.validate(spark, args.store)
        out("\n".join([status, *found]) + "\n")
        return 0 if status == "valid" else 1
    if args.command == "info":
        found = api.open(spark, args.store).info()
        if args.json:
            out(json.dumps(found) + "\n")
        else:
            out(f"{found['positions']} positions in {len(found['contigs']) + found['more_contigs']} contigs ({found['digest']})\n")
            out("".join(f"{n}\t{t['dtype']}\t{len(t['labels'])} columns\tfill {t['fill']}\t{t['size']}\n" for n, t in found["tracks"].items()))
        return 0
    if args.command in ("view", "stat"):
        write(args, _report(spark, args))
        return 0
    pairs = [text.parse_source(x) for x in args.sources] + (text.read_source_list(spark, args.file_list) if args.file_list else [])
    if not pairs:
        raise ValueError("no sources")
    sources, labels = [p for p, _ in pairs], api.labels_of(pairs)
    bed = {"dim": args.dim, "fields": args.field, "track": args.track, "dtype": args.dtype, "infer_rows": None if args.infer_rows == "all" else int(args.infer_rows)}
    asked, fill = text.read_schema(spark, args.schema) if args.schema else None, text.parse_fill(args.fill)
    if args.emit_schema:
        sys.stdout.write(text.emit_schema(text.bed_schema(spark, sources, fill, asked=asked, **{k: v for k, v in bed.items() if k != "dim"})))
        return 0
    options = pileup.PileupOptions(parse_flags(args.exclude), args.min_mapq, args.min_bq, args.count_deletions, args.mates)
    if args.command == "import":
        new = not files.exists(spark, args.store)
        if new and not args.reference:
            raise ValueError("a new store needs --reference")
        store = api.create(spark, args.store, text.read_fai(spark, args.reference)) if new else api.open(spark, args.store, read_only=False)
        try:
            if args.reference and not new and text.read_fai(spark, args.reference) != store.reference:
                raise ValueError("the store has another reference")
            if args.kind == "bed":
                api.import_bed(store, sources, asked, fill, labels, **bed)
            elif args.kind == "bigwig":
                api.import_bigwig(store, sources, args.track or "signal", None if fill == text.UNSET else fill, labels)
            else:
                api.import_bam(store, sources, args.track or "depth", options, labels, pileup.FIELDS if args.composition else ("depth",))
        except BaseException:
            if new:  # a failed import leaves no new store behind
                files.delete(spark, args.store)
            raise
        return 0
    store = api.open(spark, args.store, read_only=False)
    name = args.track or store.names[0]
    known = store.meta["tracks"][name]
    for path, label in zip(sources, labels, strict=True):
        if args.kind == "bam":
            reference, reads = text.read_sam(spark, path, label) if path.endswith(".sam") else api.read_bam(spark, path, label)
            more = pileup.depth(reads, reference, options, (label,))
        elif args.kind == "bigwig":
            reference, found = api.read_bigwig(spark, path, label)
            more = pileup.Track(found, reference, (label,), known["fill"])
        else:
            more = next(iter(text.import_bed(spark, [(path, label)], store.reference, asked, fill, **bed).values()))
        typed = more.runs.withColumn("value", more.runs["value"].cast(known["dtype"]))
        store.append(name, pileup.Track(typed, more.reference, (label,), known["fill"], known["dim"]))
    return 0


def _report(spark: SparkSession, args):
    """The header line and then the lines of view or stat."""
    store = api.open(spark, args.store)
    track = store[args.track] if args.track else store.only()
    if args.columns:
        if track.labels == ("",):
            raise ValueError("the track has no columns")
        track = track.select(args.columns.split(","))
    regions = _regions(spark, args, store.reference)
    if args.command == "view":
        regions = regions if regions is not None else reduce.contig_regions(spark, store.reference).where("end > 0")
        found = runs.view(track, regions, digits=args.digits)
        yield "\t".join(["#chrom", "start", "end", *[x or (args.track or store.names[0]) for x in track.labels]])
        for r in runs.view_lines(found, args.digits).toLocalIterator():
            yield r.value
        return
    found = reduce.stat(track, regions, args.statistic)
    yield "\t".join(found.columns)
    for r in found.toLocalIterator():
        yield "\t".join(format_g(x, args.digits) if isinstance(x, float) or x is None else str(x) for x in r)


def write(args, lines) -> None:
    """Lines to the output file, as BGZF for .gz, or to standard output; a reader that goes away ends it in peace."""
    if args.no_header:
        next(lines)
    if not args.output:
        try:
            for line in lines:
                sys.stdout.write(line + "\n")
            sys.stdout.flush()
        except BrokenPipeError:
            sys.stdout = None
        return
    raw = open(args.output, "xb")  # noqa: SIM115
    out = BgzfWriter(raw) if args.output.endswith(".gz") else raw
    try:
        for line in lines:
            out.write(line.encode() + b"\n")
    finally:
        out.close()


if __name__ == "__main__":
    sys.exit(main())
