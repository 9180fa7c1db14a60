"""Registered queries over the shared tables, each with its DuckDB equivalent.

The tables stand in for genomic ones: l_returnflag is the contig (A, N, R, of
the 2,500 days that ship dates span), the day since 1995-01-01 the position,
l_linestatus the sample. ``depth`` is the day's summed quantity, with the value
missing on days ending in 3. Alignments are lineitem rows from order date to ship date.

The ``long_`` queries have contigs that grow with the data: each order has SPACING
positions, each of its lines a run of 60 or 100 of them, with NaN for the values of
every tenth order; regions are those of the parts, some 5,000 to 8,000 positions each.
The queries of files and stores write what they read in the shared folder first.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grammar import quantize
from ..operators import algebra, mask, pileup, reduce, runs
from ..sources import files
from ..sources import store as stores
from ..sources import text as sources
from ..sources.text import last_wins
from ..streaming import append
from .reference import Reference
from .track import Track, as_regions, points_track

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAYS = 2500
REFERENCE = Reference([("A", DAYS), ("N", DAYS), ("R", DAYS)])
LABELS = ("F", "O")
BUCKET = 256
#: Literal regions: overlapping, repeated, out of order, one base wide, whole contigs.
REGIONS = [("A", 100, 400), ("N", 0, 2500), ("A", 300, 700), ("R", 1000, 1001), ("A", 100, 400), ("R", 2400, 2500), ("N", 1200, 1900)]

PTS = """pts AS (
  SELECT l_returnflag AS contig, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS pos, l_linestatus AS label,
         CASE WHEN date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 10 <> 3 THEN CAST(sum(l_quantity) AS BIGINT) END AS v, count(*) AS c
  FROM lineitem GROUP BY ALL)"""
PTS = PTS.replace("GROUP BY ALL", "GROUP BY l_returnflag, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)), l_linestatus")
REG = "reg AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', {s}, {e})" for i, (c, s, e) in enumerate(REGIONS)) + ") t(region_id, contig, s, e))"
LAB = "lab AS (SELECT * FROM (VALUES ('F'), ('O')) t(label))"
#: Every region, label and base, with the fill-less value.
CELLS = f"WITH {PTS}, {REG}, {LAB}, cell AS (SELECT region_id, lab.label, s, e, pts.pos, v FROM reg CROSS JOIN lab LEFT JOIN pts ON pts.contig = reg.contig AND pts.label = lab.label AND pos >= s AND pos < e)"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, pos, label, value, c): a day's quantity (missing on days ending in 3) and rows."""
    pos = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("contig"), pos.alias("pos"), F.col("l_linestatus").alias("label"), "l_quantity")
    days = rows.groupBy("contig", "pos", "label").agg(F.sum("l_quantity").cast("long").alias("q"), F.count(F.lit(1)).alias("c"))
    return days.select("contig", "pos", "label", F.when(F.col("pos") % 10 != 3, F.col("q")).alias("value"), "c")


def depth_track(spark: SparkSession, sf_dir: str, fill=None) -> Track:
    return points_track(points(spark, sf_dir), REFERENCE, LABELS, fill)


def count_track(spark: SparkSession, sf_dir: str) -> Track:
    return points_track(points(spark, sf_dir).withColumn("value", F.col("c")), REFERENCE, LABELS, 0)


def regions(spark: SparkSession) -> DataFrame:
    return as_regions(spark, REGIONS, REFERENCE)


def _reduced(name: str, reducer: str, expression: str, kind: str = "double", **options) -> None:
    sql = f"{CELLS} SELECT CAST(region_id AS BIGINT) AS region_id, label, {expression} AS value FROM cell GROUP BY region_id, label, s, e"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = reduce.reduce_regions(depth_track(spark, sf_dir), regions(spark), reducer, bucket=BUCKET, **options)
        value = F.round(F.col("value").cast("double"), 6) if kind == "double" else F.col("value").cast("long")
        return out.select("region_id", "label", value.alias("value"))

    query(name, sql)(run)


_reduced("region_mean", "mean", "round(avg(v), 6)")
_reduced("region_sum", "sum", "CAST(coalesce(sum(v), 0) AS BIGINT)", "long")
_reduced("region_count", "count", "count(v)", "long")
_reduced("region_min", "min", "min(v)", "long")
_reduced("region_max", "max", "max(v)", "long")
_reduced("region_var", "var", "round(var_pop(v), 6)")
_reduced("region_std_ddof1", "std", "round(stddev_samp(v), 6)", ddof=1)
_reduced("region_median", "median", "round(median(v), 6)")
_reduced("region_quantile", "quantile", "round(quantile_cont(v, 0.25), 6)", q=0.25)
_reduced("region_skipna_false", "mean", "CASE WHEN count(v) = e - s THEN round(avg(v), 6) END", skipna=False)


@query("region_quantiles", f"{CELLS}, q AS (SELECT * FROM (VALUES (0.1), (0.5), (0.9)) t(quantile)), r AS (SELECT region_id, label, quantile_cont(v, [0.1, 0.5, 0.9]) AS vs FROM cell GROUP BY region_id, label) SELECT CAST(region_id AS BIGINT) AS region_id, label, CAST(unnest([0.1, 0.5, 0.9]) AS DOUBLE) AS quantile, round(unnest(coalesce(vs, [NULL, NULL, NULL])), 6) AS value FROM r")
def region_quantiles(spark, sf_dir):
    out = reduce.reduce_regions(depth_track(spark, sf_dir), regions(spark), "quantile", q=[0.1, 0.5, 0.9], bucket=BUCKET)
    return out.select("region_id", "label", "quantile", F.round("value", 6).alias("value"))


@query("fill_vs_null", f"{CELLS} SELECT CAST(region_id AS BIGINT) AS region_id, label, round(coalesce(CAST(sum(v) AS DOUBLE), 0) / (e - s - count(*) FILTER (pos IS NOT NULL AND v IS NULL)), 6) AS value FROM cell GROUP BY region_id, label, s, e")
def fill_vs_null(spark, sf_dir):
    """Means where uncovered bases count as the fill 0 and missing ones don't count."""
    out = reduce.reduce_regions(depth_track(spark, sf_dir, fill=0), regions(spark), "mean", bucket=BUCKET)
    return out.select("region_id", "label", F.round("value", 6).alias("value"))


@query("region_summit", f"{CELLS}, k AS (SELECT region_id, cell.label, cell.pos, cell.v, coalesce(p.c, 0) AS c FROM (SELECT region_id, reg.contig, lab.label, reg.s + g.i AS pos, pts.v FROM reg CROSS JOIN lab CROSS JOIN (SELECT unnest(range(2500)) AS i) g LEFT JOIN pts ON pts.contig = reg.contig AND pts.label = lab.label AND pts.pos = reg.s + g.i WHERE g.i < reg.e - reg.s) cell LEFT JOIN pts p ON p.contig = cell.contig AND p.label = cell.label AND p.pos = cell.pos) SELECT CAST(region_id AS BIGINT) AS region_id, label, CAST(pos AS BIGINT) AS summit_position, c AS rows, v AS depth FROM (SELECT *, row_number() OVER (PARTITION BY region_id, label ORDER BY c DESC, v DESC NULLS LAST, pos) AS k FROM k) WHERE k = 1")
def region_summit(spark, sf_dir):
    out = reduce.summit({"rows": count_track(spark, sf_dir), "depth": depth_track(spark, sf_dir)}, regions(spark), ["rows", "depth"])
    return out.select("region_id", "label", "summit_position", "rows", "depth")


@query("stat_contig_mean", f"WITH {PTS} SELECT CAST(CASE contig WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS region_id, label, round(avg(v), 6) AS value FROM (SELECT c.contig, l.label, v FROM (VALUES ('A'), ('N'), ('R')) c(contig) CROSS JOIN (VALUES ('F'), ('O')) l(label) LEFT JOIN pts ON pts.contig = c.contig AND pts.label = l.label) GROUP BY contig, label")
def stat_contig_mean(spark, sf_dir):
    out = reduce.stat(depth_track(spark, sf_dir), None, "mean")
    return out.select("region_id", "label", F.round("value", 6).alias("value"))


@query("stat_median_lower", f"{CELLS} SELECT CAST(region_id AS BIGINT) AS region_id, label, quantile_disc(v, 0.5) AS value FROM cell GROUP BY region_id, label")
def stat_median_lower(spark, sf_dir):
    return reduce.stat(depth_track(spark, sf_dir), regions(spark), "median").select("region_id", "label", "value")


@query("stat_hist_union", f"WITH {PTS}, {REG}, u AS (SELECT DISTINCT pts.contig, pos, label, c FROM pts JOIN reg ON pts.contig = reg.contig AND pos >= s AND pos < e), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT contig, p FROM (SELECT contig, unnest(range(s, e)) AS p FROM reg))), h AS (SELECT CAST(c AS BIGINT) AS value, count(*) FILTER (label = 'F') AS f, count(*) FILTER (label = 'O') AS o FROM u GROUP BY c UNION ALL SELECT 0, n - (SELECT count(*) FROM u WHERE label = 'F'), n - (SELECT count(*) FROM u WHERE label = 'O') FROM n) SELECT value, CAST(sum(f) AS BIGINT) AS F, CAST(sum(o) AS BIGINT) AS O FROM h GROUP BY value")
def stat_hist_union(spark, sf_dir):
    return reduce.stat(count_track(spark, sf_dir), regions(spark), "hist")


#: Every order as an interval of 1 to 30 days; customers are dealt to 251 contigs a status, so that gaps and overlaps both stay.
ORDERS = "ord AS (SELECT o_orderstatus || '-' || o_custkey % 251 AS contig, o_orderkey AS line, CAST(o_custkey % 10 AS BIGINT) AS v, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS s, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 1 + o_orderkey % 30 AS e FROM orders)"
ORDER_REFERENCE = Reference([(f"{status}-{k}", 4000) for status in "FOP" for k in range(251)])


def order_lines(spark, sf_dir) -> DataFrame:
    """(contig, start, end, label, value, line) of every order."""
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    contig = F.concat_ws("-", "o_orderstatus", F.col("o_custkey") % 251)
    return table(spark, sf_dir, "orders").select(contig.alias("contig"), start.alias("start"), (start + 1 + F.col("o_orderkey") % 30).alias("end"), F.lit("").alias("label"), (F.col("o_custkey") % 10).cast("long").alias("value"), F.col("o_orderkey").alias("line"))


ISLANDS = f"WITH {ORDERS}, m AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT contig, s, e FROM ord)), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m), isl AS (SELECT contig, CAST(min(s) AS BIGINT) AS s, CAST(max(e) AS BIGINT) AS e FROM g GROUP BY contig, k)"


@query("interval_coalesce", f'{ISLANDS} SELECT contig, s AS start, e AS "end" FROM isl')
def interval_coalesce(spark, sf_dir):
    return mask.coalesce_intervals(order_lines(spark, sf_dir), ORDER_REFERENCE.bucket()).select("contig", "start", "end")


@query("interval_mask_bases", f"{ISLANDS}, t AS (SELECT contig, sum(e - s) AS n FROM isl GROUP BY contig) SELECT contig, CAST(n AS BIGINT) AS masked, CAST(4000 - n AS BIGINT) AS unmasked FROM t")
def interval_mask_bases(spark, sf_dir):
    cover = mask.interval_mask(order_lines(spark, sf_dir), ORDER_REFERENCE).cover().runs
    n = F.col("end") - F.col("start")
    return cover.groupBy("contig").agg(F.sum(F.when(F.col("value"), n).otherwise(0)).alias("masked"), F.sum(F.when(~F.col("value"), n).otherwise(0)).alias("unmasked")).where("masked > 0")


@query("region_slice", f"WITH {PTS}, {LAB} SELECT 'A' AS contig, CAST(g.p AS BIGINT) AS pos, 'A:' || g.p AS position, lab.label, v AS value FROM (SELECT unnest(range(120, 180)) AS p) g CROSS JOIN lab LEFT JOIN pts ON pts.contig = 'A' AND pts.label = lab.label AND pts.pos = g.p")
def region_slice(spark, sf_dir):
    return mask.region(depth_track(spark, sf_dir), "A:120-180").select("contig", "pos", "position", "label", "value")


@query("region_bins", f"WITH {PTS}, {LAB} SELECT CAST(g.p AS BIGINT) AS pos, lab.label, v AS value FROM (SELECT unnest(range(700, 1000, 100)) AS p) g CROSS JOIN lab LEFT JOIN (SELECT label, pos // 100 * 100 AS pos, CAST(sum(v) AS BIGINT) AS v FROM pts WHERE contig = 'R' GROUP BY 1, 2) b ON b.label = lab.label AND b.pos = g.p")
def region_bins(spark, sf_dir):
    """Bins of 100 that a region meets, whole ones, from a track of bin sums."""
    sums = algebra.binned(depth_track(spark, sf_dir), 100, "sum")
    binned = Track(sums.select("contig", (F.col("bin") * 100).alias("start"), F.least((F.col("bin") + 1) * 100, F.lit(DAYS)).alias("end"), "label", F.nullif("value", F.lit(-1)).alias("value")), REFERENCE, LABELS)
    held = depth_track(spark, sf_dir).runs.select("contig", F.floor(F.col("start") / 100).alias("bin"), "label").distinct()
    out = mask.region(binned, "R:750-1000", "bin_100")
    known = held.where("contig = 'R'").select((F.col("bin") * 100).alias("pos"), "label", F.lit(True).alias("known"))
    return out.join(known, ["pos", "label"], "left").select("pos", "label", F.when(F.col("known"), F.col("value")).alias("value"))


VIEW = f"WITH {PTS}, {REG}, b AS (SELECT region_id, reg.contig, s + i AS p, s FROM reg CROSS JOIN (SELECT unnest(range(2500)) AS i) WHERE i < e - s), w AS (SELECT region_id, b.contig, b.p, max(CAST(c > 2 AS INT)) FILTER (label = 'F') AS f, max(CAST(c > 2 AS INT)) FILTER (label = 'O') AS o FROM b LEFT JOIN pts ON pts.contig = b.contig AND pts.pos = b.p GROUP BY region_id, b.contig, b.p)"


@query("view_runs", VIEW + ", k AS (SELECT * FROM w WHERE f IS NOT NULL OR o IS NOT NULL), m AS (SELECT *, CASE WHEN lag(p) OVER x = p - 1 AND lag(f) OVER x IS NOT DISTINCT FROM f AND lag(o) OVER x IS NOT DISTINCT FROM o THEN 0 ELSE 1 END AS fresh FROM k WINDOW x AS (PARTITION BY region_id ORDER BY p)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY region_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT CAST(region_id AS BIGINT) AS region_id, contig, CAST(min(p) AS BIGINT) AS start, CAST(max(p) + 1 AS BIGINT) AS \"end\", any_value(f) AS F, any_value(o) AS O FROM n GROUP BY region_id, contig, run")
def view_runs(spark, sf_dir):
    track = points_track(points(spark, sf_dir).withColumn("value", (F.col("c") > 2).cast("int")), REFERENCE, LABELS)
    return runs.view(track, regions(spark))


@query("binned_mean", f"WITH {PTS} SELECT contig, CAST(pos // 30 AS BIGINT) AS bin, label, round(avg(v), 6) AS value FROM pts WHERE v IS NOT NULL GROUP BY contig, pos // 30, label")
def binned_mean(spark, sf_dir):
    return algebra.binned(depth_track(spark, sf_dir), 30).where("value IS NOT NULL").select("contig", "bin", "label", F.round("value", 6).alias("value"))


@query("rolling_mean", f"WITH {PTS}, {LAB}, g AS (SELECT c.contig, lab.label, p, coalesce(pts.c, 0) AS c FROM (VALUES ('A'), ('N'), ('R')) c(contig) CROSS JOIN lab CROSS JOIN (SELECT unnest(range(2500)) AS p) LEFT JOIN pts ON pts.contig = c.contig AND pts.label = lab.label AND pts.pos = p), r AS (SELECT contig, label, p, avg(c) OVER w AS m, count(*) OVER w AS n FROM g WINDOW w AS (PARTITION BY contig, label ORDER BY p ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT contig, CAST(p AS BIGINT) AS pos, label, CASE WHEN n = 7 THEN round(m, 6) END AS value FROM r")
def rolling_mean(spark, sf_dir):
    return algebra.rolling_mean(count_track(spark, sf_dir), 7, block=512).select("contig", "pos", "label", F.round("value", 6).alias("value"))


READS = "rd AS (SELECT l_returnflag AS contig, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS s, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS e, l_linestatus AS label, l_linenumber AS mapq FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) >= DATE '1992-01-01')"
DEPTH = "ev AS (SELECT contig, label, p, sum(d) AS d FROM (SELECT contig, label, s AS p, 1 AS d FROM {0} UNION ALL SELECT contig, label, e, -1 FROM {0}) GROUP BY contig, label, p), run AS (SELECT contig, label, CAST(p AS BIGINT) AS s, CAST(lead(p) OVER w AS BIGINT) AS e, sum(d) OVER (PARTITION BY contig, label ORDER BY p ROWS UNBOUNDED PRECEDING) AS v FROM ev WINDOW w AS (PARTITION BY contig, label ORDER BY p))"
READ_REFERENCE = Reference([("A", 6000), ("N", 6000), ("R", 6000)])


def lineitem_reads(spark, sf_dir) -> DataFrame:
    """(contig, start, end, label, mapq): lineitem rows from order date to ship date."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    both = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_linenumber").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = both.select(F.col("l_returnflag").alias("contig"), day("o_orderdate").alias("start"), day("l_shipdate").alias("end"), F.col("l_linestatus").alias("label"), F.col("l_linenumber").alias("mapq"))
    return rows.where("end > start AND start >= 0")


def _depth_bases(track: Track) -> DataFrame:
    n = F.col("end") - F.col("start")
    return track.runs.groupBy("contig", "label", F.col("value").cast("long").alias("depth")).agg(F.sum(n).alias("bases"))


@query("pileup_depth", f"WITH {READS}, {DEPTH.format('rd')} SELECT contig, label, CAST(v AS BIGINT) AS depth, CAST(sum(e - s) AS BIGINT) AS bases FROM run WHERE v > 0 AND e IS NOT NULL GROUP BY contig, label, v")
def pileup_depth(spark, sf_dir):
    return _depth_bases(pileup.sweep(lineitem_reads(spark, sf_dir), READ_REFERENCE, LABELS))


@query("pileup_filtered", f"WITH {READS}, f AS (SELECT * FROM rd WHERE mapq >= 3), {DEPTH.format('f')} SELECT contig, label, CAST(v AS BIGINT) AS depth, CAST(sum(e - s) AS BIGINT) AS bases FROM run WHERE v > 0 AND e IS NOT NULL GROUP BY contig, label, v")
def pileup_filtered(spark, sf_dir):
    return _depth_bases(pileup.sweep(lineitem_reads(spark, sf_dir).where("mapq >= 3"), READ_REFERENCE, LABELS))


@query("mate_dedup_depth", "WITH r AS (SELECT l_returnflag AS contig, l_orderkey AS q, l_linenumber // 2 AS h, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS s FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY contig, q, h ORDER BY s) AS n FROM r), f AS (SELECT contig, q, h, s AS fs FROM k WHERE n = 1), b AS (SELECT k.contig, k.s + i AS p FROM k JOIN f USING (contig, q, h) CROSS JOIN (SELECT unnest(range(20)) AS i) WHERE NOT (k.n = 2 AND k.s + i < fs + 20)) SELECT contig, count(*) AS bases, CAST(sum(n) AS BIGINT) AS depth_sum, max(n) AS depth_max FROM (SELECT contig, p, count(*) AS n FROM b GROUP BY contig, p) GROUP BY contig")
def mate_dedup_depth(spark, sf_dir):
    """Neighbouring lines of an order as mates of 20 bases: where the first two overlap, a base counts once."""
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_returnflag", "l_orderkey", F.floor(F.col("l_linenumber") / 2)).alias("qname"), F.col("l_returnflag").alias("contig"), start.alias("start"),
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line"),
    )
    order = Window.partitionBy("contig", "qname").orderBy("start", "line")
    other = F.coalesce(F.lead("start").over(order), F.lag("start").over(order))
    reads = rows.select(
        "*", F.lit("").alias("label"), F.when(other.isNotNull(), 0x1 | 0x2).otherwise(0x1 | 0x8).alias("flag"), F.lit(60).alias("mapq"), F.lit("20M").alias("cigar"),
        F.coalesce(other, F.lit(-1)).alias("mate_start"), F.lit(True).alias("same_contig"), F.lit("*").alias("seq"), F.lit("*").alias("qual"),
    )
    runs_ = pileup.depth(reads, READ_REFERENCE).runs
    n = F.col("end") - F.col("start")
    return runs_.groupBy("contig").agg(F.sum(n).alias("bases"), F.sum(F.col("value") * n).alias("depth_sum"), F.max("value").cast("long").alias("depth_max"))


@query("callable_fraction", f"WITH {PTS}, {LAB}, t AS (SELECT contig, label, count(*) FILTER (c >= 3) AS n FROM pts GROUP BY contig, label) SELECT lab.label, CAST(coalesce(sum(n), 0) AS BIGINT) AS bases, round(coalesce(sum(n), 0) / 7500.0, 6) AS fraction FROM lab LEFT JOIN t USING (label) GROUP BY lab.label")
def callable_fraction(spark, sf_dir):
    called = count_track(spark, sf_dir).map((F.col("value") >= 3).cast("int"), 0)
    totals = algebra.label_totals(called)
    return totals.select("label", F.col("total").cast("long").alias("bases"), F.round("mean", 6).alias("fraction"))


@query("callable_per_region", f"WITH {PTS}, {REG}, {LAB} SELECT CAST(region_id AS BIGINT) AS region_id, lab.label, count(*) FILTER (c >= 3) AS value FROM reg CROSS JOIN lab LEFT JOIN pts ON pts.contig = reg.contig AND pts.label = lab.label AND pos >= s AND pos < e GROUP BY region_id, lab.label")
def callable_per_region(spark, sf_dir):
    called = count_track(spark, sf_dir).map((F.col("value") >= 3).cast("int"), 0)
    return reduce.reduce_regions(called, regions(spark), "sum", bucket=BUCKET).select("region_id", "label", F.col("value").cast("long").alias("value"))


@query("cohort_normalize", f"WITH {PTS}, m AS (SELECT label, sum(c) / 7500.0 AS mean FROM pts GROUP BY label) SELECT contig, CAST(pos AS BIGINT) AS pos, label, round(c / mean, 6) AS value FROM pts JOIN m USING (label)")
def cohort_normalize(spark, sf_dir):
    track = count_track(spark, sf_dir)
    out = algebra.by_label(track, algebra.label_totals(track).select("label", "mean"), F.col("value") / F.col("mean"))
    return out.dense().select("contig", "pos", "label", F.round("value", 6).alias("value"))


def _aligned(spark, sf_dir, how: str) -> DataFrame:
    a = mask.region(depth_track(spark, sf_dir), "N:1250-1350").where("value IS NOT NULL")
    b = mask.region(count_track(spark, sf_dir), "N:1300-1400").where("value > 0")
    return mask.align_loci(a, b, how).select("contig", "pos", "label", F.col("left_value").alias("depth"), F.col("right_value").alias("rows"))


ALIGN = "WITH {0}, a AS (SELECT * FROM pts WHERE contig = 'N' AND pos BETWEEN 1250 AND 1349 AND v IS NOT NULL), b AS (SELECT * FROM pts WHERE contig = 'N' AND pos BETWEEN 1300 AND 1399 AND c > 0) SELECT 'N' AS contig, CAST(coalesce(a.pos, b.pos) AS BIGINT) AS pos, coalesce(a.label, b.label) AS label, a.v AS depth, b.c AS rows FROM a {1} JOIN b ON a.pos = b.pos AND a.label = b.label"
for _how in ("inner", "outer", "left", "right"):
    query(f"locus_align_{_how}", ALIGN.format(PTS, "FULL OUTER" if _how == "outer" else _how.upper()))(lambda spark, sf_dir, how=_how: _aligned(spark, sf_dir, how))


@query("threshold_outer", f"WITH {PTS} SELECT label, CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (c >= threshold) AS bases FROM pts CROSS JOIN (VALUES (1), (3), (5)) t(threshold) GROUP BY label, threshold")
def threshold_outer(spark, sf_dir):
    wide = algebra.thresholds(count_track(spark, sf_dir), [1.0, 3.0, 5.0])
    return wide.groupBy("label", "threshold").agg(F.coalesce(F.sum(F.when(F.col("value"), F.col("end") - F.col("start"))), F.lit(0)).alias("bases"))


@query("summarize_samples", f"WITH {PTS}, p AS (SELECT contig, pos, coalesce(max(c) FILTER (label = 'F'), 0) AS f, coalesce(max(c) FILTER (label = 'O'), 0) AS o FROM pts GROUP BY contig, pos) SELECT contig, CAST(greatest(f, o) AS BIGINT) AS most, round((f + o) / 2.0, 6) AS mean, count(*) AS bases FROM p GROUP BY contig, greatest(f, o), round((f + o) / 2.0, 6)")
def summarize_samples(spark, sf_dir):
    found = algebra.across_labels(count_track(spark, sf_dir), most=F.max("value"), mean=F.avg("value"))
    return found.groupBy("contig", "most", F.round("mean", 6).alias("mean")).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


@query("combine_tracks", f"WITH {PTS} SELECT contig, label, count(*) AS bases, CAST(sum(v - c) AS BIGINT) AS total FROM pts WHERE v IS NOT NULL GROUP BY contig, label")
def combine_tracks(spark, sf_dir):
    both = algebra.combine({"depth": depth_track(spark, sf_dir), "rows": count_track(spark, sf_dir)}, F.col("depth") - F.col("rows"))
    known = both.runs.where("value IS NOT NULL")
    return known.groupBy("contig", "label").agg(F.sum(F.col("end") - F.col("start")).alias("bases"), F.sum(F.col("value") * (F.col("end") - F.col("start"))).alias("total"))


@query("mask_where", f"WITH {PTS}, {REG}, u AS (SELECT DISTINCT contig, p FROM (SELECT contig, unnest(range(s, e)) AS p FROM reg)) SELECT pts.contig, label, CAST(sum(c) AS BIGINT) AS total FROM pts JOIN u ON u.contig = pts.contig AND u.p = pts.pos GROUP BY pts.contig, label")
def mask_where(spark, sf_dir):
    kept = mask.where(count_track(spark, sf_dir), mask.interval_mask(regions(spark), REFERENCE))
    total = F.sum(F.col("value") * (F.col("end") - F.col("start")))
    return kept.runs.where("value > 0").groupBy("contig", "label").agg(total.alias("total"))


def _sets(name: str, how: str, condition: str) -> None:
    sql = f"WITH {REG}, g AS (SELECT contig, p, bool_or(region_id % 2 = 0) AS a, bool_or(region_id % 2 = 1) AS b FROM (SELECT region_id, contig, unnest(range(s, e)) AS p FROM reg) GROUP BY contig, p), k AS (SELECT contig, p, p - row_number() OVER (PARTITION BY contig ORDER BY p) AS run FROM g WHERE {condition}) SELECT contig, CAST(min(p) AS BIGINT) AS start, CAST(max(p) + 1 AS BIGINT) AS \"end\" FROM k GROUP BY contig, run"

    def run(spark, sf_dir):
        even, odd = (mask.interval_mask(regions(spark).where(f"region_id % 2 = {k}"), REFERENCE) for k in (0, 1))
        return mask.combine_masks(even, odd, how).select("contig", "start", "end")

    query(name, sql)(run)


_sets("interval_intersect", "and", "a AND b")
_sets("interval_union", "or", "a OR b")
_sets("interval_except", "andnot", "a AND NOT b")


@query("bed_last_wins", f"WITH {ORDERS}, b AS (SELECT contig, line, v, unnest(range(s, e)) AS p FROM ord), w AS (SELECT contig, p, arg_max(v, line) AS v FROM b GROUP BY contig, p) SELECT contig, v AS value, count(*) AS bases FROM w GROUP BY contig, v")
def bed_last_wins(spark, sf_dir):
    """Overlapping interval lines of every order: each base has the value of the last line that covers it."""
    return last_wins(order_lines(spark, sf_dir), ORDER_REFERENCE.bucket()).groupBy("contig", "value").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


@query("quantized_runs", f"WITH {PTS}, d AS (SELECT label, v, CAST(pow(10, greatest(length(CAST(abs(v) AS VARCHAR)) - 1, 0)) AS BIGINT) AS unit FROM pts WHERE v IS NOT NULL) SELECT label, CAST(round(v / unit) * unit AS BIGINT) AS value, count(*) AS bases FROM d GROUP BY 1, 2")
def quantized_runs(spark, sf_dir):
    """All values, of any magnitude, rounded to one significant digit, halves away from zero."""
    rows = depth_track(spark, sf_dir).runs.where("value IS NOT NULL")
    return rows.groupBy("label", F.round(quantize(F.col("value"), 1)).cast("long").alias("value")).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


@query("genome_positions", f"WITH {PTS} SELECT CAST(CASE contig WHEN 'A' THEN 0 WHEN 'N' THEN 2500 ELSE 5000 END + pos AS BIGINT) AS position, contig || ':' || pos AS locus, label, c AS value FROM pts")
def genome_positions(spark, sf_dir):
    """The flat position axis with locus labels."""
    flat = REFERENCE.flat(F.col("contig"), F.col("pos"))
    return count_track(spark, sf_dir).dense().select(flat.cast("long").alias("position"), F.concat_ws(":", "contig", "pos").alias("locus"), "label", "value")


COMPOSE = "SELECT l_returnflag AS contig, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS s, l_orderkey % 4 AS k FROM lineitem"


def _composition(rows: DataFrame) -> DataFrame:
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    seq = F.upper(F.substring(F.lit("acgtacgtacgt"), (F.col("l_orderkey") % 4 + 1).cast("int"), F.lit(6)))
    reads = rows.select(F.lit("*").alias("qname"), F.col("l_returnflag").alias("contig"), F.lit("").alias("label"), F.lit(0).alias("flag"), start.alias("start"), F.lit(60).alias("mapq"), F.lit("4M2D2M1I").alias("cigar"), F.lit(-1).alias("mate_start"), F.lit(False).alias("same_contig"), F.concat(seq, F.lit("A")).alias("seq"), F.lit("*").alias("qual"), F.col("l_orderkey").alias("line"))
    found = pileup.composition(reads)
    kinds = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("a", "c", "g", "t", "ins", "del")]))
    return found.select("contig", "pos", kinds).where("n > 0").groupBy("contig", "kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("pos")).alias("positions"))


@query("pileup_composition", f"WITH r AS ({COMPOSE}), m AS (SELECT contig, s + i AS p, substr('acgt', CAST((i + k) % 4 + 1 AS INTEGER), 1) AS b FROM r CROSS JOIN (SELECT unnest(range(4)) AS i)), d AS (SELECT contig, s + 4 + i AS p, 'del' AS b FROM r CROSS JOIN (SELECT unnest(range(2)) AS i)), e AS (SELECT contig, s + 6 + i AS p, substr('acgt', CAST((i + 4 + k) % 4 + 1 AS INTEGER), 1) AS b FROM r CROSS JOIN (SELECT unnest(range(2)) AS i)), i AS (SELECT contig, s + 7 AS p, 'ins' AS b FROM r), u AS (SELECT * FROM m UNION ALL SELECT * FROM d UNION ALL SELECT * FROM e UNION ALL SELECT * FROM i) SELECT contig, b AS kind, count(*) AS n, CAST(sum(p) AS BIGINT) AS positions FROM u GROUP BY contig, b")
def pileup_composition(spark, sf_dir):
    """Base composition of synthetic reads 4M2D2M1I, one for every line, over the reference acgt, shifted by order."""
    return _composition(table(spark, sf_dir, "lineitem"))


SPACING = 1000
SIG = "sig AS (SELECT l_returnflag AS contig, l_linestatus AS label, l_orderkey * 1000 + l_linenumber * 100 AS s, l_orderkey * 1000 + l_linenumber * 100 + min(CASE WHEN l_suppkey % 2 = 0 THEN 100 ELSE 60 END) AS e, CASE WHEN l_orderkey % 10 <> 3 THEN sum(l_quantity) / 4 END AS v FROM lineitem GROUP BY l_returnflag, l_linestatus, l_orderkey, l_linenumber)"
PARTS = "preg AS (SELECT p_partkey AS region_id, substr('ANR', CAST(p_partkey % 3 + 1 AS INTEGER), 1) AS contig, p_partkey * 7000 AS s, p_partkey * 7000 + 5000 + p_partkey % 3000 AS e FROM part)"
MEETS = "FROM preg CROSS JOIN lab LEFT JOIN sig ON sig.contig = preg.contig AND sig.label = lab.label AND sig.s < preg.e AND preg.s < sig.e"


def signal_track(spark, sf_dir) -> Track:
    top = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0] or 0
    start = F.col("l_orderkey") * SPACING + F.col("l_linenumber") * 100
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("contig"), start.alias("start"), F.col("l_linestatus").alias("label"), F.when(F.col("l_suppkey") % 2 == 0, 100).otherwise(60).alias("n"), "l_quantity")
    one = rows.groupBy("contig", "start", "label").agg(F.min("n").alias("n"), F.sum("l_quantity").alias("q"))
    value = F.when(F.floor(F.col("start") / SPACING) % 10 != 3, F.col("q") / 4).otherwise(F.lit(float("nan")))
    return Track(one.select("contig", "start", (F.col("start") + F.col("n")).alias("end"), "label", value.alias("value")), Reference([(c, (top + 1) * SPACING) for c in "ANR"]), LABELS)


def part_regions(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("region_id"), F.substring(F.lit("ANR"), (key % 3 + 1).cast("int"), F.lit(1)).alias("contig"), (key * 7000).alias("start"), (key * 7000 + 5000 + key % 3000).alias("end"))


def _long_reduced(reducer: str, expression: str, **options) -> None:
    sql = f"WITH {SIG}, {PARTS}, {LAB} SELECT region_id, lab.label, {expression} AS value {MEETS} GROUP BY region_id, lab.label"

    def run(spark, sf_dir):
        track = signal_track(spark, sf_dir)
        out = reduce.reduce_regions(track, as_regions(spark, part_regions(spark, sf_dir), track.reference), reducer, **options)
        return out.select("region_id", "label", F.round(F.col("value").cast("double"), 6).alias("value"))

    query(f"long_region_{reducer}", sql)(run)


OVERLAP = "(least(sig.e, preg.e) - greatest(sig.s, preg.s))"
_long_reduced("sum", f"round(coalesce(sum(v * {OVERLAP}), 0), 6)")
_long_reduced("mean", f"round(sum(v * {OVERLAP}) / sum({OVERLAP}) FILTER (v IS NOT NULL), 6)")
_long_reduced("count", f"CAST(coalesce(sum({OVERLAP}) FILTER (v IS NOT NULL), 0) AS DOUBLE)")
_long_reduced("max", "max(v)")


@query("long_region_median", f"WITH {SIG}, {PARTS}, {LAB}, b AS (SELECT region_id, lab.label, v, unnest(range(CASE WHEN v IS NULL THEN 1 ELSE CAST({OVERLAP} AS BIGINT) END)) AS i {MEETS}) SELECT region_id, label, round(quantile_cont(v, 0.5), 6) AS value FROM b GROUP BY region_id, label")
def long_region_median(spark, sf_dir):
    track = signal_track(spark, sf_dir)
    out = reduce.reduce_regions(track, as_regions(spark, part_regions(spark, sf_dir), track.reference), "median")
    return out.select("region_id", "label", F.round("value", 6).alias("value"))


@query("long_contig_quantiles", f"WITH {SIG}, b AS (SELECT contig, label, v, unnest(range(e - s)) AS i FROM sig WHERE v IS NOT NULL), r AS (SELECT contig, label, quantile_cont(v, [0.05, 0.5, 0.99]) AS vs FROM b GROUP BY contig, label) SELECT contig, label, CAST(unnest([0.05, 0.5, 0.99]) AS DOUBLE) AS quantile, round(unnest(vs), 6) AS value FROM r")
def long_contig_quantiles(spark, sf_dir):
    """Quantiles over whole contigs, whose values are found by counts and cumulative sums."""
    track = signal_track(spark, sf_dir)
    contigs = reduce.contig_regions(spark, track.reference)
    out = reduce.reduce_regions(track, contigs, "quantile", q=[0.05, 0.5, 0.99])
    return out.join(F.broadcast(contigs.select("region_id", "contig")), "region_id").select("contig", "label", "quantile", F.round("value", 6).alias("value")).where("value IS NOT NULL")


@query("long_view", f"WITH {SIG}, q AS (SELECT contig, s, e, CASE WHEN v = 0 THEN 0 ELSE round(v * pow(10, -floor(log10(v)))) / pow(10, -floor(log10(v))) END AS v FROM sig WHERE v IS NOT NULL AND label = 'F'), m AS (SELECT *, CASE WHEN lag(e) OVER w = s AND lag(v) OVER w = v THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY contig ORDER BY s)), k AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT contig, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS \"end\", round(any_value(v), 6) AS F FROM k GROUP BY contig, run")
def long_view(spark, sf_dir):
    """Runs of whole contigs after rounding to one digit; NaN is left out."""
    track = signal_track(spark, sf_dir)
    found = runs.view(track, reduce.contig_regions(spark, track.reference), ["F"], 1)
    return found.select("contig", "start", "end", F.round("F", 6).alias("F"))


@query("long_coalesce", f"WITH {SIG}, m AS (SELECT contig, s, e, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT contig, s, e FROM sig)), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT contig, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS \"end\" FROM g GROUP BY contig, k")
def long_coalesce(spark, sf_dir):
    track = signal_track(spark, sf_dir)
    return mask.coalesce_intervals(track.runs, track.reference.bucket()).select("contig", "start", "end")


@query("long_totals", f"WITH {SIG} SELECT label, CAST(sum(v * (e - s)) AS DOUBLE) AS total, CAST(sum(e - s) FILTER (v IS NOT NULL) AS BIGINT) AS bases FROM sig GROUP BY label")
def long_totals(spark, sf_dir):
    return algebra.label_totals(signal_track(spark, sf_dir)).select("label", F.col("total").cast("double").alias("total"), "bases")


@query("long_binned", f"WITH {SIG} SELECT contig, CAST(s // 100000 AS BIGINT) AS bin, label, round(sum(v * (e - s)) / sum(e - s), 6) AS value FROM sig WHERE v IS NOT NULL GROUP BY contig, s // 100000, label")
def long_binned(spark, sf_dir):
    return algebra.binned(signal_track(spark, sf_dir), 100_000).where("value IS NOT NULL").select("contig", "bin", "label", F.round("value", 6).alias("value"))


@query("long_across_labels", f"WITH {SIG}, k AS (SELECT * FROM sig WHERE v IS NOT NULL), j AS (SELECT coalesce(f.contig, o.contig) AS contig, coalesce(f.e - f.s, 0) AS nf, coalesce(o.e - o.s, 0) AS no, f.v AS vf, o.v AS vo FROM (SELECT * FROM k WHERE label = 'F') f FULL JOIN (SELECT * FROM k WHERE label = 'O') o ON f.contig = o.contig AND f.s = o.s), p AS (SELECT contig, 2 AS labels, least(nf, no) AS n, greatest(vf, vo) AS most FROM j WHERE nf > 0 AND no > 0 UNION ALL SELECT contig, 1, greatest(nf, no) - least(nf, no), CASE WHEN nf > no THEN vf ELSE vo END FROM j WHERE nf <> no) SELECT contig, CAST(labels AS BIGINT) AS labels, CAST(sum(n) AS BIGINT) AS bases, CAST(sum(n * most) AS DOUBLE) AS total FROM p GROUP BY contig, labels")
def long_across_labels(spark, sf_dir):
    found = algebra.across_labels(signal_track(spark, sf_dir), labels=F.count("value"), most=F.max("value")).where("labels > 0")
    n = F.col("end") - F.col("start")
    return found.groupBy("contig", "labels").agg(F.sum(n).alias("bases"), F.sum(F.col("most") * n).alias("total"))


COLUMN_TOTALS = f"WITH {PTS} SELECT label, CAST(sum(c) AS BIGINT) AS total FROM pts GROUP BY label"


def _column_totals(track: Track) -> DataFrame:
    return track.runs.groupBy("label").agg(F.sum(F.col("value") * (F.col("end") - F.col("start"))).cast("long").alias("total"))


def _half_store(spark, sf_dir) -> tuple[stores.Store, Track]:
    """A store whose ``rows`` have the column F, and the track of both columns."""
    both = count_track(spark, sf_dir)
    both = Track(both.runs.withColumn("value", F.col("value").cast("double")), REFERENCE, LABELS, 0.0)
    store = stores.create(spark, files.scratch_path(spark, "store"), REFERENCE)
    store.write({"rows": both.select(["F"])})
    return store, both


@query("append_columns", COLUMN_TOTALS)
def append_columns(spark, sf_dir):
    """A store of one column that another is appended to, opened anew."""
    store, both = _half_store(spark, sf_dir)
    store.append("rows", both.select(["O"]))
    return _column_totals(stores.open_store(spark, store.path)["rows"])


@query("stream_append", COLUMN_TOTALS)
def stream_append(spark, sf_dir):
    """The other column arrives in two files, read as a stream; its rows of both batches count, a replay doesn't."""
    store, both = _half_store(spark, sf_dir)
    folder, check = files.scratch_path(spark, "arriving"), files.scratch_path(spark, "progress")
    late = both.select(["O"]).runs.select("contig", "start", "end", "label", "value")
    for k in (0, 1, 1):
        late.where(F.col("start") % 2 == k).write.mode("append").parquet(folder)
        append.append_stream(append.watch_runs(spark, folder), store.path, "rows", check).awaitTermination()
    return _column_totals(stores.open_store(spark, store.path)["rows"])


@query("zip_store", COLUMN_TOTALS)
def zip_store(spark, sf_dir):
    """A store packed as one file and opened from it."""
    store, both = _half_store(spark, sf_dir)
    store.append("rows", both.select(["O"]))
    with tempfile.TemporaryDirectory() as folder:
        stores.pack(spark, store.path, f"{folder}/rows.zip")
        return _column_totals(stores.open_zip(spark, f"{folder}/rows.zip", files.scratch_path(spark, "unpacked"))["rows"])


@query("store_validate", "SELECT 'valid' AS status, 'rows' AS track, 'F,O' AS labels, 'double' AS dtype, CAST(7500 AS BIGINT) AS positions")
def store_validate(spark, sf_dir):
    store, both = _half_store(spark, sf_dir)
    store.append("rows", both.select(["O"]))
    status, _ = stores.validate(spark, store.path)
    found = store.info()
    return spark.createDataFrame([(status, n, ",".join(t["labels"]), t["dtype"], found["positions"]) for n, t in found["tracks"].items()], "status string, track string, labels string, dtype string, positions long")


@query("region_file", ORACLES["region_sum"])
def region_file(spark, sf_dir):
    """Regions of a BED file, with comment and track lines, in file order."""
    path = files.scratch_path(spark, "regions")
    text = ["# regions", "track name=x", *[f"{c}\t{s}\t{e}" for c, s, e in REGIONS], "", "browser hide all"]
    spark.createDataFrame([(t,) for t in text], "value string").coalesce(1).write.text(path)
    read = sources.read_regions(spark, path, REFERENCE)
    out = reduce.reduce_regions(depth_track(spark, sf_dir), read.select("region_id", "contig", "start", "end"), "sum", bucket=BUCKET)
    return out.select((F.col("region_id") - 2).alias("region_id"), "label", F.col("value").cast("long").alias("value"))


@query("view_file", ORACLES["view_runs"].replace("SELECT CAST(region_id AS BIGINT) AS region_id, contig, CAST(min(p) AS BIGINT) AS start, CAST(max(p) + 1 AS BIGINT) AS \"end\", any_value(f) AS F, any_value(o) AS O", "SELECT contig || chr(9) || min(p) || chr(9) || (max(p) + 1) || chr(9) || coalesce(CAST(any_value(f) AS VARCHAR), 'NaN') || chr(9) || coalesce(CAST(any_value(o) AS VARCHAR), 'NaN') AS line") + " UNION ALL SELECT '#chrom' || chr(9) || 'start' || chr(9) || 'end' || chr(9) || 'F' || chr(9) || 'O'")
def view_file(spark, sf_dir):
    """The text export, written and read back."""
    path = files.scratch_path(spark, "view")
    runs.write_view(view_runs(spark, sf_dir), path, compressed=True)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("locus_select", f"WITH {PTS}, {LAB} SELECT 'A:' || g.p AS position, lab.label, v AS value FROM (VALUES (125), (121), (150)) g(p) CROSS JOIN lab LEFT JOIN pts ON pts.contig = 'A' AND pts.label = lab.label AND pts.pos = g.p")
def locus_select(spark, sf_dir):
    view = mask.region(depth_track(spark, sf_dir), "A:120-180")
    return mask.select_loci(view, ["A:125", "A:121", "A:150"]).select("position", "label", "value")


@query("bed_schema", "SELECT * FROM (VALUES ('4', 'digit', 'uint8'), ('5', 'day', 'uint16'), ('6', 'tenth', 'float32'), ('7', 'signed', 'int8')) t(selector, track, dtype)")
def bed_schema(spark, sf_dir):
    """Types inferred from all cells of a BED file of orders, whose dates span some 2,400 days."""
    path, value = files.scratch_path(spark, "typed"), F.col("value")
    cells = F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), *[c.cast("string") for c in (value, F.col("start"), value / 10, value - 9)])
    order_lines(spark, sf_dir).select(cells.alias("value")).write.text(path)
    asked = [sources.Column(str(4 + i), n) for i, n in enumerate(("digit", "day", "tenth", "signed"))]
    return spark.createDataFrame([(c.selector, c.track, c.dtype) for c in sources.bed_schema(spark, path, asked=asked, infer_rows=None)], "selector string, track string, dtype string")


@query("bed_import", f"WITH {ORDERS}, b AS (SELECT line % 2 AS odd, contig, line, v, unnest(range(s, e)) AS p FROM ord), w AS (SELECT odd, contig, p, arg_max(v, line) AS v FROM b GROUP BY odd, contig, p), t AS (SELECT odd, 'digit' AS track, CAST(v AS DOUBLE) AS value FROM w UNION ALL SELECT odd, 'low', CASE WHEN v < 5 THEN 1 ELSE 0 END FROM w) SELECT track, CASE odd WHEN 0 THEN 'even' ELSE 'odd' END AS label, value, count(*) AS bases FROM t GROUP BY track, odd, value")
def bed_import(spark, sf_dir):
    """Two BED files of orders with two value columns, whose types are inferred over all cells: a track each, a column for each file."""
    lines = order_lines(spark, sf_dir)
    paths = []
    for k, label in enumerate(("even", "odd")):
        paths.append((files.scratch_path(spark, label), label))
        cells = F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), F.col("value").cast("string"), (F.col("value") < 5).cast("int").cast("string"))
        own = lines.where(F.col("line") % 2 == k).repartitionByRange("line").sortWithinPartitions("line")
        own.select(cells.alias("value")).write.text(paths[-1][0])
    tracks = sources.import_bed(spark, paths, ORDER_REFERENCE, [sources.Column("4", "digit"), sources.Column("5", "low")], infer_rows=None)
    found = None
    for name, track in tracks.items():
        part = track.runs.select(F.lit(name).alias("track"), "label", F.col("value").cast("int").cast("double").alias("value"), (F.col("end") - F.col("start")).alias("n"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("track", "label", "value").agg(F.sum("n").alias("bases"))


@query("sam_depth", f"WITH {READS}, one AS (SELECT contig, '' AS label, s, e FROM rd), {DEPTH.format('one')} SELECT contig, CAST(sum(v * (e - s)) AS BIGINT) AS total, CAST(sum(e - s) FILTER (v > 0) AS BIGINT) AS bases, CAST(max(v) AS BIGINT) AS most FROM run WHERE e IS NOT NULL GROUP BY contig")
def sam_depth(spark, sf_dir):
    """Every line as an alignment of a SAM file, read back and piled up."""
    path = files.scratch_path(spark, "sam")
    reads = lineitem_reads(spark, sf_dir)
    size = F.col("end") - F.col("start")
    cells = F.concat_ws("\t", F.lit("*"), F.lit("0"), "contig", (F.col("start") + 1).cast("string"), F.lit("60"), F.concat(size.cast("string"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"))
    head = spark.createDataFrame([(f"@SQ\tSN:{n}\tLN:{x}",) for n, x in READ_REFERENCE.items()], "value string")
    head.unionByName(reads.select(cells.alias("value"))).write.text(path)
    reference, found = sources.read_sam(spark, path)
    track = pileup.depth(found, reference)
    n = F.col("end") - F.col("start")
    return track.runs.groupBy("contig").agg(F.sum(F.col("value") * n).cast("long").alias("total"), F.sum(n).alias("bases"), F.max("value").cast("long").alias("most"))
