"""Text sources: FAI and chrom.sizes, region BED, value BED with inference, bedGraph, SAM, source lists."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.runs import collapse
from ..plans.reference import Reference
from ..plans.track import Track

#: Gap value of each kind of source, where the caller gives none: depth-like ones 0, signals missing.
GAPS = {"bam": 0, "d4": 0, "bigwig": None, "bed": None, "mask": False}
# Integer types from the narrowest, with their bounds; the largest value of each is its missing mark.
WIDTHS = {"uint8": (0, 2**8 - 1), "uint16": (0, 2**16 - 1), "uint32": (0, 2**32 - 1), "int8": (-(2**7), 2**7 - 1), "int16": (-(2**15), 2**15 - 1), "int32": (-(2**31), 2**31 - 1)}
SPARK_TYPES = {"bool": "boolean", "int8": "byte", "int16": "short", "int32": "int", "int64": "long", "uint8": "short", "uint16": "int", "uint32": "long", "uint64": "decimal(20,0)", "float32": "float", "float64": "double"}
TRUE_WORDS, FALSE_WORDS = ("true", "True", "TRUE"), ("false", "False", "FALSE")
#: A fill that nobody gave: gaps are missing, or false in boolean tracks. None is a given "missing".
UNSET = "unset"
#: Records that types are inferred from by default.
SAMPLE = 1000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): a text file's (or gzip's) lines with their numbers from 0.

    A file of one split is numbered as it is read. The lines of others are counted by
    split first; numbers are then the split's first one and the place in it.
    """
    raw = spark.read.text(path)
    order = F.monotonically_increasing_id()
    if raw.rdd.getNumPartitions() <= 1:
        return raw.select(order.alias("line"), "value")
    placed = raw.select(order.alias("order"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    first, starts = 0, []
    for r in placed.groupBy("file", "block").agg(F.min("order").alias("order"), F.count(F.lit(1)).alias("n")).orderBy("file", "block").collect():  # one row a split
        starts.append((r.file, r.block, first - r.order))
        first += r.n
    table = spark.createDataFrame(starts, "file string, block long, shift long")
    return placed.join(F.broadcast(table), ["file", "block"]).select((F.col("order") + F.col("shift")).alias("line"), "value")


def read_fai(spark: SparkSession, path: str) -> Reference:
    """Columns 1 and 2 (name, length) of a FAI or chrom.sizes file; blank lines are skipped."""
    rows = lines(spark, path).where(F.trim("value") != "").select("line", F.split("value", r"\t").alias("c"))
    return Reference([(r.n, int(r.x)) for r in rows.select("line", F.col("c")[0].alias("n"), F.col("c")[1].alias("x")).orderBy("line").collect()])


def read_regions(spark: SparkSession, path: str, reference: Reference) -> DataFrame:
    """(region_id, contig, start, end, name) of a BED file in file order, duplicates kept; invalid ranges raise with their line."""
    rows = lines(spark, path).withColumn("c", F.split("value", r"\t"))
    rows = rows.where((F.trim("value") != "") & ~F.col("value").rlike("^(#|track|browser)"))
    known = F.broadcast(reference.frame(spark).select("contig", "length"))
    cut = rows.select("line", "value", F.get("c", F.lit(0)).alias("contig"), F.get("c", F.lit(1)).try_cast("long").alias("start"), F.get("c", F.lit(2)).try_cast("long").alias("end"), F.get("c", F.lit(3)).alias("name")).join(known, "contig", "left")
    fine = F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("length")), F.lit(False))
    wrong = F.concat(F.lit("invalid region on line "), (F.col("line") + 1).cast("string"), F.lit(": "), F.col("value"))
    return cut.select(F.col("line").alias("region_id"), "contig", F.when(fine, F.col("start")).otherwise(F.raise_error(wrong).cast("long")).alias("start"), "end", "name")


def parse_source(text: str) -> tuple[str, str | None]:
    """PATH[:LABEL]: split on the last colon unless a path separator follows it."""
    path, colon, label = text.rpartition(":")
    return (path, label) if colon and path and "/" not in label and "\\" not in label else (text, None)


def default_label(path: str, extensions: tuple[str, ...] = (".bed", ".bedgraph", ".bam", ".cram", ".sam", ".d4", ".bw", ".bigwig")) -> str:
    """File name without one format extension, and without .gz or .bgz before that."""
    name = path.rsplit("/", 1)[-1]
    for tail in (".gz", ".bgz"):
        name = name.removesuffix(tail)
    return next((name[: -len(e)] for e in extensions if name.lower().endswith(e) and len(name) > len(e)), name)


def read_source_list(spark: SparkSession, path: str) -> list[tuple[str, str | None]]:
    """PATH[<TAB>LABEL] lines; # comments; relative paths are taken from the list's folder."""
    base, found = path.rsplit("/", 1)[0] if "/" in path else ".", []
    for r in lines(spark, path).orderBy("line").collect():
        if r.value.strip() and not r.value.startswith("#"):
            name, _, label = r.value.strip().partition("\t")
            found.append((name if name.startswith("/") or "://" in name else f"{base}/{name}", label or None))
    if len({label is None for _, label in found}) > 1:
        raise ValueError("either all sources or none have labels")
    return found


@dataclass(frozen=True)
class Column:
    """A value column of a BED file: its header name (or number from 4), target track, type ('': to be inferred) and fill."""

    selector: str
    track: str
    dtype: str = ""
    fill: object = UNSET

    @property
    def gap(self):
        """The value of bases that no interval covers."""
        return (False if self.dtype == "bool" else None) if self.fill == UNSET else self.fill


def infer_dtype(low, high, words: bool, integral: bool, exact: bool, fill=UNSET, wide: bool = False) -> str:
    """Type of a column from what its cells are: bounds, whether there are true/false words, whether all are integers.

    Words go with 0 and 1 only, and make a boolean; so do 0 and 1 alone, where all cells
    were seen (``exact``) and gaps aren't to be missing (``fill`` None). Integers take the
    narrowest type that keeps its largest value free for missing cells (not needed
    when ``fill`` is a value), of 32 bits where only a sample was seen. Others are
    float32, or float64 where that can't hold them (``wide``).
    """
    small = integral and low >= 0 and high <= 1
    if words and not small:
        raise ValueError("a column mixes true/false with numbers")
    if small and (words or (exact and fill is not None)):
        return "bool"
    if not integral:
        return "float64" if wide else "float32"
    spare = 1 if fill in (None, UNSET) else 0
    for name in WIDTHS if exact else ("int32", "uint32"):
        lo, hi = WIDTHS[name]
        if lo <= low and high <= hi - spare and (name[0] == "u") == (low >= 0 and exact or name == "uint32"):
            return name
    raise ValueError(f"integers {low} to {high} exceed 32 bits")


def _cells(spark: SparkSession, path: str) -> tuple[DataFrame, list[str] | None]:
    """(line, value, c): the records of a BED file with their cells; and the names of its header line, if it has one."""
    raw = lines(spark, path)
    head = raw.where("value LIKE '#%'").orderBy(F.desc("line")).limit(1).collect()
    body = raw.where((F.trim("value") != "") & ~F.col("value").rlike("^(#|track|browser)")).withColumn("c", F.split("value", r"\t"))
    return body, head[0].value[1:].split("\t") if head else None


def parse_fill(text: str | None):
    """A fill as text: na (missing), true or false, a number (whole ones become integers); UNSET if none is given."""
    if text is None or text == "":
        return UNSET
    if text in ("na", "NA"):
        return None
    if text in TRUE_WORDS + FALSE_WORDS:
        return text in TRUE_WORDS
    try:
        value = float(text)
    except ValueError:
        raise ValueError(f"bad fill {text!r}") from None
    if value != value or abs(value) == float("inf"):
        raise ValueError(f"bad fill {text!r}")
    return int(text) if text.lstrip("+-").isdigit() else int(value) if value == int(value) else value


def _observed(cells: DataFrame, fills: dict[str, object], exact: bool) -> dict[str, str]:
    """The type of each column of text cells, all in one pass."""
    aggregates = []
    for i, name in enumerate(fills):
        cell = F.trim(F.col(f"`{name}`"))
        word = cell.isin(*TRUE_WORDS, *FALSE_WORDS)
        whole = cell.rlike(r"^[+-]?\d+$")
        integer = F.when(word, cell.isin(*TRUE_WORDS).cast("decimal(38,0)")).when(whole, cell.try_cast("decimal(38,0)"))
        number = F.when(~word, cell.try_cast("double"))
        bad = ~word & (number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")))
        aggregates += [F.min(integer).alias(f"lo{i}"), F.max(integer).alias(f"hi{i}"), F.max(word).alias(f"w{i}"), F.min(word | whole).alias(f"i{i}"), F.max(F.coalesce(bad, F.lit(True))).alias(f"bad{i}"), F.max(F.abs(number) > 3.4028234663852886e38).alias(f"wide{i}")]
    seen, found = cells.agg(*aggregates).first(), {}
    for i, (name, fill) in enumerate(fills.items()):
        if seen[f"i{i}"] is None:
            raise ValueError(f"column {name} has no values to infer a type from")
        if seen[f"bad{i}"]:
            raise ValueError(f"column {name} has cells that are neither finite numbers nor booleans")
        found[name] = infer_dtype(seen[f"lo{i}"], seen[f"hi{i}"], bool(seen[f"w{i}"]), bool(seen[f"i{i}"]), exact, fill, bool(seen[f"wide{i}"]))
    return found


def _file_column(selector: str, header: list[str] | None) -> int:
    """Number (from 0) of the column that a header name or a number from 4 selects."""
    if selector.isascii() and selector.isdigit():
        at = int(selector) - 1
    elif header and selector in header:
        if header.count(selector) > 1:
            raise ValueError(f"the header has several columns {selector!r}")
        at = header.index(selector)
    else:
        raise ValueError(f"no column {selector!r} in the header")
    if at < 3:
        raise ValueError(f"column {selector!r} holds coordinates; value columns start at 4")
    return at


def bed_schema(spark: SparkSession, paths: str | list[str], fill=UNSET, fields: list[str] | None = None, track: str | None = None, dtype: str | None = None, infer_rows: int | None = SAMPLE, asked: list[Column] | None = None) -> list[Column]:
    """The value columns of BED files with their tracks and types; empty for BED3, whose one track is a mask.

    Headed files give the columns ``fields`` (all by default) as a track each, or as
    the columns of the one ``track``; headless files of four columns give one. Types that
    aren't given are inferred from the first ``infer_rows`` records of each file (None: all),
    over all files; a file that has no more is seen as a whole. ``asked`` gives the columns instead,
    those of dtype '' to be inferred.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    bodies = [_cells(spark, p) for p in paths]
    header = bodies[0][1]
    width = len(header) if header else max((r.w or 3) for r in [bodies[0][0].agg(F.max(F.size("c")).alias("w")).first()])
    if asked is None:
        if width <= 3:
            if fields:
                raise ValueError("the file has no value columns")
            return []
        if header:
            asked = [Column(n, track or n, "", fill) for n in (fields or header[3:])]
        elif fields:
            raise ValueError("fields are named by a header line, which the file lacks")
        elif width == 4:
            asked = [Column("4", track or default_label(paths[0]), dtype or "", fill)]
        else:
            asked = [Column(str(i + 1), track or str(i + 1), "", fill) for i in range(3, width)]
    check_schema(asked, len(paths))
    unknown = [c for c in asked if not c.dtype]
    if not unknown:
        return asked
    limit = None if infer_rows is None else infer_rows + 1
    parts, exact = None, True
    for body, names in bodies:
        if limit:
            first = body.orderBy("line").limit(limit)
            exact = exact and first.count() < limit
            body = first.orderBy("line").limit(infer_rows)
        cells = body.select(*[F.get("c", F.lit(_file_column(c.selector, names))).alias(c.selector) for c in unknown])
        parts = cells if parts is None else parts.unionByName(cells)
    if len({c.track for c in asked}) == 1 < len(asked):
        # One track has one type: all its columns are seen as one.
        joint = parts.select(F.explode(F.array(*[F.col(f"`{c.selector}`") for c in unknown])).alias("cell"))
        kinds = dict.fromkeys((c.selector for c in unknown), _observed(joint, {"cell": unknown[0].fill}, exact)["cell"])
    else:
        kinds = _observed(parts, {c.selector: c.fill for c in unknown}, exact)
    return [c if c.dtype else replace(c, dtype=kinds[c.selector]) for c in asked]


def check_schema(columns: list[Column], sources: int) -> None:
    """Tracks are all different, or all one (of one source, one type and one fill); a column is taken once."""
    tracks = [c.track for c in columns]
    if not columns:
        raise ValueError("the schema selects no columns")
    if len({c.selector for c in columns}) < len(columns):
        raise ValueError("a column is selected twice")
    if any(not t for t in tracks):
        raise ValueError("a column lacks a track")
    if len(set(tracks)) not in (1, len(tracks)):
        raise ValueError("columns go to tracks of their own, or all to one")
    if len(tracks) > 1 and len(set(tracks)) == 1:
        if sources > 1:
            raise ValueError("several columns make one track of a single source only")
        if len({(c.dtype, repr(c.fill)) for c in columns}) > 1:
            raise ValueError("columns of one track have one type and one fill")


def read_schema(spark: SparkSession, path: str) -> list[Column]:
    """Columns of a TSV (column, track and, if given, dtype and fill) as emit_schema() writes it."""
    found = []
    for r in lines(spark, path).orderBy("line").collect():
        cells = [*r.value.split("\t"), "", "", ""][:4]
        if r.value.strip() and not r.value.startswith("#") and cells[:2] != ["column", "track"]:
            if cells[2] and cells[2] not in SPARK_TYPES:
                raise ValueError(f"unknown type {cells[2]!r}")
            found.append(Column(cells[0], cells[1], cells[2], parse_fill(cells[3])))
    return found


def emit_schema(columns: list[Column]) -> str:
    """A TSV scaffold: column, track, dtype, fill."""
    return "".join("\t".join(r) + "\n" for r in [("column", "track", "dtype", "fill"), *[(c.selector, c.track, c.dtype, "" if c.fill == UNSET else "na" if c.fill is None else str(c.fill).lower()) for c in columns]])


def last_wins(runs: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """(contig, start, end, label, value) without overlaps: of (…, line) runs the later line wins.

    Runs are cut at bucket bounds, so that break points and winners are found within
    buckets; pieces of one value that touch merge again.
    """
    at = F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket)))
    cut = runs.where("start < end").withColumn("bucket", at)
    cut = cut.withColumns({"lo": F.greatest("start", F.col("bucket") * bucket), "hi": F.least("end", (F.col("bucket") + 1) * bucket)}).drop("start", "end")
    marks = cut.select("contig", "label", "bucket", F.explode(F.array("lo", "hi")).alias("start")).distinct()
    order = Window.partitionBy("contig", "label", "bucket").orderBy("start")
    pieces = marks.withColumn("end", F.lead("start").over(order)).where("end IS NOT NULL")
    met = pieces.join(cut, ["contig", "label", "bucket"]).where("lo <= start AND start < hi")
    won = met.groupBy("contig", "label", "start", "end").agg(F.max_by("value", "line").alias("value"))
    return collapse(won, bucket)


def import_bed(spark: SparkSession, sources: list[tuple[str, str]], reference: Reference, schema: list[Column] | None = None, fill=UNSET, dim: str = "sample", track: str | None = None, **options) -> dict[str, Track]:
    """Tracks of BED files (path, label), by name; ``options`` are those of bed_schema().

    BED3 gives a boolean track (``mask`` by default); each value column gives a track with
    a column for each file, or the columns of one file make one track together. Ends past a
    contig are clipped, lines on unknown contigs are not read, and on overlap the
    later line wins. A cell that isn't of its column's type, or equals its missing mark, raises.
    """
    paths, labels = [p for p, _ in sources], tuple(label for _, label in sources)
    columns = bed_schema(spark, paths, fill, track=track, asked=schema, **options)
    if not columns and fill != UNSET:
        raise ValueError("a mask has no fill")
    columns = columns or [Column("", track or "mask", "bool")]
    wide = len(columns) > 1 and len({c.track for c in columns}) == 1
    parts: dict[str, DataFrame] = {}
    known = F.broadcast(reference.frame(spark).select("contig", "length"))
    for path, label in sources:
        body, header = _cells(spark, path)
        place = body.select("line", "c", F.col("c")[0].alias("contig"), F.col("c")[1].cast("long").alias("start"), F.col("c")[2].cast("long").alias("end")).join(known, "contig")
        place = place.withColumn("end", F.least("end", "length")).where("start < end")
        for col in columns:
            value = _cell_value(F.trim(F.get("c", F.lit(_file_column(col.selector, header)))), col) if col.selector else F.lit(True)
            runs = place.select("contig", "start", "end", F.lit(col.selector if wide else label).alias("label"), value.alias("value"), "line")
            parts[col.track] = runs if col.track not in parts else parts[col.track].unionByName(runs)
    own = {c.track: c for c in columns}
    labels = tuple(c.selector for c in columns) if wide else labels
    return {n: Track(last_wins(runs, reference.bucket()), reference, labels, own[n].gap, dim) for n, runs in parts.items()}


def _cell_value(cell, col: Column):
    """A cell as its column's type; what isn't of it, or equals its missing mark, raises with the line's number."""
    kind = SPARK_TYPES[col.dtype]
    if col.dtype == "bool":
        value = F.when(cell.isin("1", *TRUE_WORDS), True).when(cell.isin("0", *FALSE_WORDS), False)
    else:
        value = cell.try_cast(kind)
        if col.dtype in WIDTHS:
            low, high = WIDTHS[col.dtype]
            value = F.when(value.between(low, high if col.gap is not None else high - 1), value)
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"bad cell of {col.track} on line "), (F.col("line") + 1).cast("string"))).cast(kind))


def read_bedgraph(spark: SparkSession, path: str, reference: Reference, label: str = "", fill=None) -> Track:
    """A float track of a bedGraph file; NaN cells are missing, unknown contigs raise."""
    body, _ = _cells(spark, path)
    rows = body.select("line", F.col("c")[0].alias("contig"), F.col("c")[1].cast("long").alias("start"), F.col("c")[2].cast("long").alias("end"), F.lit(label).alias("label"), F.nanvl(F.col("c")[3].cast("float"), F.lit(None).cast("float")).alias("value"))
    checked = rows.join(F.broadcast(reference.frame(spark).select("contig", "length")), "contig", "left")
    good = F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("length")), F.lit(False))
    wrong = F.concat(F.lit("interval outside of the reference on line "), (F.col("line") + 1).cast("string"))
    start = F.when(good, F.col("start")).otherwise(F.raise_error(wrong).cast("long"))
    return Track(last_wins(checked.withColumn("start", start).drop("length"), reference.bucket()), reference, (label,), fill)


def read_sam(spark: SparkSession, path: str, label: str = "") -> tuple[Reference, DataFrame]:
    """The reference of the @SQ lines, and reads (line, qname, flag, contig, start, mapq, cigar, mate_start, same_contig, seq, qual, label).

    Positions become 0-based. A header without @SQ is refused.
    """
    raw = lines(spark, path)
    heads = [r.value for r in raw.where("value LIKE '@SQ%'").orderBy("line").collect()]
    if not heads:
        raise ValueError(f"{path} has no @SQ line")
    tags = [dict(t.split(":", 1) for t in h.split("\t")[1:]) for h in heads]
    reference = Reference([(t["SN"], int(t["LN"])) for t in tags])
    c = lambda i: F.col("c")[i]
    body = raw.where(~F.col("value").startswith("@") & (F.trim("value") != "")).withColumn("c", F.split("value", r"\t"))
    reads = body.select(
        "line", c(0).alias("qname"), c(1).cast("int").alias("flag"), c(2).alias("contig"), (c(3).cast("int") - 1).alias("start"), c(4).cast("int").alias("mapq"), c(5).alias("cigar"),
        (c(7).cast("int") - 1).alias("mate_start"), ((c(6) == "=") | (c(6) == c(2))).alias("same_contig"), c(9).alias("seq"), c(10).alias("qual"), F.lit(label).alias("label"),
    )
    return reference, reads.where((F.col("contig") != "*") & (F.col("start") >= 0))


def safe_name(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.-]*", name))
