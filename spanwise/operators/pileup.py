"""Alignment pileup: depth and base composition with filters and mate-overlap handling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grammar import DEFAULT_EXCLUDE
from ..plans.reference import Reference
from ..plans.track import Track

FIELDS = ("depth", "a", "c", "g", "t", "n", "ins", "del", "ref_skip")
MATES = ("none", "proper", "all")


@dataclass(frozen=True)
class PileupOptions:
    exclude_flags: int = DEFAULT_EXCLUDE
    min_mapq: int = 0
    min_base_quality: int = 0
    count_deletions: bool = False
    mates: str = "proper"


def sweep(segments: DataFrame, reference: Reference, labels: tuple[str, ...] = ("",), weight: Column | int = 1) -> Track:
    """Depth of (contig, start, end, label) segments as runs: events of + and - ``weight``, summed within buckets; fill 0."""
    bucket, weight = reference.bucket(), F.lit(weight) if isinstance(weight, int) else weight
    cut = Track(segments.withColumn("value", weight), reference, labels).split(bucket)
    events = cut.select("contig", "bucket", "label", F.inline(F.array(F.struct(F.col("start").alias("pos"), F.col("value").alias("d")), F.struct(F.col("end").alias("pos"), (-F.col("value")).alias("d")))))
    steps = events.groupBy("contig", "bucket", "label", "pos").agg(F.sum("d").alias("d")).where("d <> 0")
    order = Window.partitionBy("contig", "bucket", "label").orderBy("pos")
    runs = steps.select("contig", F.col("pos").alias("start"), F.lead("pos").over(order).alias("end"), "label", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("value"))
    return Track(runs.where("end IS NOT NULL AND value > 0"), reference, labels, 0)


#: Operations that are added up one by one; sums of so many are added up before.
STRIDE = 64


def _operations(cigar: Column) -> Column:
    """An array of (size, op)."""
    each = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(each, lambda s: F.struct(F.regexp_extract(s, r"\d+", 0).cast("int").alias("size"), F.right(s, F.lit(1)).alias("op")))


def _on_reference(x: Column) -> Column:
    return F.when(x["op"].isin("M", "=", "X", "D", "N"), x["size"]).otherwise(0)


def _on_query(x: Column) -> Column:
    return F.when(x["op"].isin("M", "=", "X", "I", "S"), x["size"]).otherwise(0)


def cigar_steps(reads: DataFrame) -> DataFrame:
    """Each read's CIGAR operations with their reference and query offsets: columns span, op, size, ref_at, query_at.

    Offsets add up sums of STRIDE operations each and then at most STRIDE single ones, so that
    long reads with very many operations don't cost their square.
    """
    listed = reads.withColumn("ops", _operations(F.col("cigar")))
    total = lambda f, first, n: F.aggregate(F.slice("ops", first, n), F.lit(0), lambda acc, x: acc + f(x))
    strides = F.sequence(F.lit(0), F.floor(F.greatest(F.size("ops") - 1, F.lit(0)) / STRIDE).cast("int"))
    sums = lambda f: F.transform(strides, lambda k: total(f, k * STRIDE + 1, F.lit(STRIDE)))
    listed = listed.withColumns({"refs": sums(_on_reference), "queries": sums(_on_query)})
    before = lambda c, f, i: F.aggregate(F.slice(c, F.lit(1), F.floor(i / STRIDE).cast("int")), F.lit(0), lambda acc, x: acc + x) + total(f, F.floor(i / STRIDE).cast("int") * STRIDE + 1, i % STRIDE)
    placed = F.transform("ops", lambda x, i: F.struct(x["op"].alias("op"), x["size"].alias("size"), before("refs", _on_reference, i).alias("ref_at"), before("queries", _on_query, i).alias("query_at")))
    span = F.aggregate("refs", F.lit(0), lambda acc, x: acc + x)
    return listed.withColumn("span", span).select("*", F.inline(placed)).drop("ops", "refs", "queries")


def kept_reads(reads: DataFrame, options: PileupOptions) -> DataFrame:
    """Reads that pass the flag and mapping-quality filters."""
    passes = (F.col("flag").bitwiseAND(options.exclude_flags) == 0) & (F.col("flag").bitwiseAND(4) == 0) & (F.coalesce("mapq", F.lit(255)) >= options.min_mapq)
    return reads.where(passes & (F.col("cigar") != "*"))


def mate_roles(reads: DataFrame, options: PileupOptions) -> DataFrame:
    """(contig, label, qname, line, start, cigar, k) of pairs that meet: the first mate (k = 1) parks if the second (k = 2) starts within it.

    Both must be primary, paired and mapped, and properly so in the mode ``proper``.
    """
    bits = F.col("flag").bitwiseAND(0x1 | 0x8 | 0x100 | 0x800) == 0x1
    pairs = bits & F.col("same_contig") & (F.col("qname") != "*")
    if options.mates == "proper":
        pairs = pairs & (F.col("flag").bitwiseAND(0x2) != 0)
    order = Window.partitionBy("contig", "label", "qname").orderBy("start", "line")
    able = reads.where(pairs).select("contig", "label", "qname", "line", "start", "cigar", "mate_start")
    turn = able.withColumns({"k": F.row_number().over(order), "parks": F.first(F.struct("mate_start", "start", "cigar")).over(order)}).where("k <= 2")
    span = F.aggregate(_operations(F.col("parks.cigar")), F.lit(0), lambda acc, x: acc + _on_reference(x))
    meets = (F.col("parks.mate_start") >= F.col("parks.start")) & (F.col("parks.mate_start") < F.col("parks.start") + span)
    return turn.where(meets).drop("parks", "mate_start")


def _segments(steps: DataFrame, *ops: str) -> DataFrame:
    """(…, start, end) on the reference of the operations ``ops`` among cigar_steps()."""
    start = (F.col("start") + F.col("ref_at")).cast("long")
    return steps.where(F.col("op").isin(*ops)).withColumns({"start": start, "end": start + F.col("size")})


def claimed(reads: DataFrame, options: PileupOptions) -> DataFrame:
    """(contig, start, end, label): what second mates cover that their first mates have claimed, where any base passes.

    Aligned bases claim aligned bases; a second's deleted base is claimed by any event of the first.
    """
    keys = ["contig", "label", "qname"]
    steps = cigar_steps(mate_roles(reads, options))
    side = lambda k, *ops: _segments(steps.where(F.col("k") == k), *ops).select(*keys, "start", "end")
    first, second = side(1, "M", "=", "X").withColumnsRenamed({"start": "lo", "end": "hi"}), side(2, "M", "=", "X")
    both = second.join(first, keys).where("lo < end AND start < hi")
    found = both.select("contig", F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end"), "label")
    if options.count_deletions:
        anchor = F.col("start") + F.greatest(F.col("ref_at") - 1, F.lit(0))
        inserts = steps.where("k = 1 AND op = 'I'").select(*keys, anchor.cast("long").alias("lo"), (anchor + 1).cast("long").alias("hi"))
        marks = side(1, "D", "N").withColumnsRenamed({"start": "lo", "end": "hi"}).unionByName(inserts)
        # Base by base: deletions are short, and two marks may hold one base.
        bases = side(2, "D").select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
        held = bases.join(marks, [*[bases[k].eqNullSafe(marks[k]) for k in keys], (marks["lo"] <= bases["pos"]) & (bases["pos"] < marks["hi"])], "left_semi")
        found = found.unionByName(held.select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "label"))
    return found


def events(reads: DataFrame, options: PileupOptions = PileupOptions()) -> DataFrame:
    """(contig, pos, label, kind): one row for each counted base or event of each read.

    ``reads`` are as read_sam() gives them; ``line`` tells apart the reads of one
    name and label. Kinds: a c g t n for aligned bases (n
    where the base is unknown or of low quality), ins, del, ref_skip. An insertion
    sits on the last consumed reference base, a leading one on the read's start.
    Of two mates that overlap, the second skips what the first claimed: a position
    where the first has a passing base, or an event of the same kind.
    """
    if options.mates not in MATES:
        raise ValueError(f"unknown mate mode {options.mates!r}")
    reads = kept_reads(reads, options)
    steps = cigar_steps(reads)
    match = F.col("op").isin("M", "=", "X")
    each = F.sequence(F.lit(0), F.col("size") - 1)
    one = steps.where(match).select("*", F.explode(each).alias("i"))
    at = F.col("query_at") + F.col("i") + 1
    good = F.when(F.col("qual") == "*", F.lit(True)).otherwise(F.ascii(F.substring("qual", at, F.lit(1))) - 33 >= options.min_base_quality)
    base = F.lower(F.when(F.col("seq") == "*", F.lit("n")).otherwise(F.substring("seq", at, F.lit(1))))
    keys = ["contig", "label", "qname", "line"]
    bases = one.select(*keys, (F.col("start") + F.col("ref_at") + F.col("i")).alias("pos"), F.when(good & base.isin("a", "c", "g", "t"), base).otherwise("n").alias("kind"), good.alias("good"))
    gaps = steps.where(F.col("op").isin("D", "N")).select("*", F.explode(each).alias("i"))
    gaps = gaps.select(*keys, (F.col("start") + F.col("ref_at") + F.col("i")).alias("pos"), F.when(F.col("op") == "D", "del").otherwise("ref_skip").alias("kind"), F.lit(True).alias("good"))
    inserts = steps.where(F.col("op") == "I").select(*keys, (F.col("start") + F.greatest(F.col("ref_at") - 1, F.lit(0))).alias("pos"), F.lit("ins").alias("kind"), F.lit(True).alias("good"))
    found = bases.unionByName(gaps).unionByName(inserts).withColumn("class", F.when(F.col("kind").isin("a", "c", "g", "t", "n"), "base").otherwise("event"))
    if options.mates == "none":
        return found.select("contig", "pos", "label", "kind", "good")
    roles = mate_roles(reads, options).select("contig", "label", "qname", "line", "k")
    played = found.join(roles, ["contig", "label", "qname", "line"], "left")
    claims = played.where("k = 1 AND good").select("contig", "label", "qname", "pos", "class").distinct()
    second = played.where("k = 2").join(claims, ["contig", "label", "qname", "pos", "class"], "left_anti")
    rest = played.where("k IS NULL OR k = 1")
    columns = ["contig", "pos", "label", "kind", "good"]
    return rest.select(*columns).unionByName(second.select(*columns))


def depth(reads: DataFrame, reference: Reference, options: PileupOptions = PileupOptions(), labels: tuple[str, ...] = ("",)) -> Track:
    """Depth of each base: passing aligned bases, and deletions if counted.

    Without a base quality to pass, whole CIGAR segments are swept, and what second
    mates repeat of first ones is taken off; otherwise bases are counted one by one.
    """
    if options.mates not in MATES:
        raise ValueError(f"unknown mate mode {options.mates!r}")
    if options.min_base_quality <= 0:
        kept = kept_reads(reads, options)
        columns = ["contig", "start", "end", "label"]
        covered = _segments(cigar_steps(kept), "M", "=", "X", *(["D"] if options.count_deletions else [])).select(*columns, F.lit(1).alias("weight"))
        if options.mates != "none":
            covered = covered.unionByName(claimed(kept, options).select(*columns, F.lit(-1).alias("weight")))
        return sweep(covered, reference, labels, F.col("weight"))
    found = events(reads, options)
    counted = (F.col("kind").isin("a", "c", "g", "t", "n") & F.col("good")) | (F.col("kind") == "del" if options.count_deletions else F.lit(False))
    points = found.where(counted).groupBy("contig", "pos", "label").agg(F.count(F.lit(1)).cast("int").alias("value"))
    return Track(points.select("contig", F.col("pos").cast("long").alias("start"), (F.col("pos") + 1).cast("long").alias("end"), "label", "value"), reference, labels, 0)


def composition(reads: DataFrame, options: PileupOptions = PileupOptions()) -> DataFrame:
    """(contig, pos, label, depth, a, c, g, t, n, ins, del, ref_skip) of each base that any read touches."""
    found = events(reads, options)
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    base = F.col("kind").isin("a", "c", "g", "t", "n") & F.col("good")
    total = F.count(F.when(base | (F.col("kind") == "del" if options.count_deletions else F.lit(False)), 1)).alias("depth")
    return found.groupBy("contig", "pos", "label").agg(total, *[count(k) for k in FIELDS[1:]])


def field_track(reads: DataFrame, reference: Reference, field: str, options: PileupOptions = PileupOptions(), labels: tuple[str, ...] = ("",)) -> Track:
    """One of FIELDS as a track; bases where it counts nothing are its fill 0."""
    counted = composition(reads, options).where(F.col(field) > 0)
    return Track(counted.select("contig", F.col("pos").cast("long").alias("start"), (F.col("pos") + 1).cast("long").alias("end"), "label", F.col(field).cast("int").alias("value")), reference, labels, 0)
