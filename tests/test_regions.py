import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from spanwise.functions.grammar import quantize
from spanwise.operators import algebra, mask, reduce, runs
from spanwise.plans.reference import Reference
from spanwise.plans.track import Track, as_regions, points_track

REF = Reference([("alpha", 61), ("beta", 9), ("gamma", 33)])
OFFSET = dict(zip(REF.names, REF.offsets, strict=True))
#: Whole contigs, one base, neighbours, the same twice, and one that a short bucket cuts often.
INTERVALS = [("gamma", 0, 33), ("alpha", 7, 8), ("alpha", 8, 21), ("beta", 2, 9), ("alpha", 7, 8), ("alpha", 3, 58)]


@pytest.fixture(scope="module")
def dense():
    """(positions, two labels): tenths, some missing, and label b missing all along beta."""
    rng = np.random.default_rng(2024)
    values = np.round(rng.normal(5, 30, (REF.total, 2)), 1)
    values[rng.random(values.shape) < 0.2] = np.nan
    values[OFFSET["beta"] : OFFSET["gamma"], 1] = np.nan
    return values


@pytest.fixture(scope="module")
def track(spark, dense):
    """Missing values are NULL on even positions and NaN on odd ones."""
    rows = [(c, p, x, float(v) if v == v else (None if p % 2 == 0 else float("nan"))) for c in REF for p in range(REF[c]) for x, v in zip("ab", dense[OFFSET[c] + p], strict=True)]
    return points_track(spark.createDataFrame(rows, "contig string, pos long, label string, value double"), REF, ("a", "b"))


def windows(dense):
    return {(i, x): dense[OFFSET[c] + s : OFFSET[c] + e, k] for i, (c, s, e) in enumerate(INTERVALS) for k, x in enumerate("ab")}


@pytest.mark.parametrize("reducer,options,oracle", [
    ("sum", {}, np.nansum), ("mean", {}, np.nanmean), ("min", {}, np.nanmin), ("max", {}, np.nanmax), ("count", {}, lambda w: np.isfinite(w).sum()),
    ("var", {}, np.nanvar), ("std", {"ddof": 1}, lambda w: np.nanstd(w, ddof=1) if np.isfinite(w).sum() > 1 else np.nan),
    ("median", {}, np.nanmedian), ("quantile", {"q": 0.3}, lambda w: np.nanquantile(w, 0.3)), ("mean", {"skipna": False}, np.mean), ("sum", {"skipna": False}, np.sum),
])
@pytest.mark.filterwarnings("ignore")
def test_reducers(spark, track, dense, reducer, options, oracle):
    got = {(r.region_id, r.label): r.value for r in reduce.reduce_regions(track, as_regions(spark, INTERVALS, REF), reducer, bucket=8, **options).collect()}
    for key, w in windows(dense).items():
        want = oracle(w) if np.isfinite(w).any() or reducer in ("sum", "count") else np.nan
        assert (got[key] is None) if np.isnan(want) else got[key] == pytest.approx(float(want))


def test_options_are_checked(spark, track):
    regions = as_regions(spark, INTERVALS, REF)
    for wrong in ({"ddof": 1}, {"q": 0.5}, {"by": "x"}):
        with pytest.raises(TypeError):
            reduce.reduce_regions(track, regions, "mean", **wrong)
    for reducer, wrong in (("quantile", {"q": 2}), ("var", {"ddof": -1}), ("nope", {})):
        with pytest.raises(ValueError):
            reduce.reduce_regions(track, regions, reducer, **wrong)


def test_fill_counts_as_a_value(spark):
    one = Track(spark.createDataFrame([("alpha", 0, 4, "", 6)], "contig string, start long, end long, label string, value long"), REF, fill=0)
    got = reduce.reduce_regions(one, as_regions(spark, ["alpha:2-8", "beta"], REF), "mean").orderBy("region_id").collect()
    assert [r.value for r in got] == [2.0, 0.0]
    assert [r.value for r in reduce.stat(one, None, "median").collect()] == [0, 0, 0]
    assert [(r["value"], r["count"]) for r in reduce.stat(one, as_regions(spark, ["alpha:0-5", "alpha:0-5", "alpha:3-8"], REF), "hist").collect()] == [(0, 4), (6, 4)]


def test_summit_breaks_ties_by_the_second_track_then_place(spark):
    def t(rows):
        return Track(spark.createDataFrame(rows, "contig string, start long, end long, label string, value long"), REF, ("s1", "s2"), 0)

    tracks = {"fire": t([("alpha", 5, 9, "s1", 7), ("alpha", 3, 4, "s2", 2)]), "cover": t([("alpha", 6, 8, "s1", 3), ("alpha", 0, 9, "s2", 1)])}
    got = {r.label: (r.summit_position, r.fire, r.cover) for r in reduce.summit(tracks, as_regions(spark, "alpha:0-20", REF), ("fire", "cover")).collect()}
    assert got == {"s1": (6, 7, 3), "s2": (3, 2, 1)}


def test_region_inputs(spark):
    frame = pd.DataFrame({"#chrom": ["alpha"], "start": [1], "end": [3]})
    want = [(0, "alpha", 1, 3)]
    for x in ("alpha:1-3", ("alpha", 1, 3), [("alpha", 1, 3)], frame, (["alpha"], np.array([1]), np.array([3]))):
        assert [tuple(r) for r in as_regions(spark, x, REF).collect()] == want
    with pytest.raises(KeyError):
        as_regions(spark, "chrX:1-3", REF)
    with pytest.raises(ValueError):
        as_regions(spark, [], REF)
    with pytest.raises(TypeError):
        as_regions(spark, ("alpha", 1.5, 3), REF)
    outside = as_regions(spark, spark.createDataFrame([("alpha", 10, 62)], "contig string, start long, end long"), REF)
    with pytest.raises(Exception, match="outside"):
        outside.collect()


def test_mask_and_sets(spark):
    ref = Reference([("chr1", 6), ("chr2", 4)])
    m = mask.interval_mask(as_regions(spark, ["chr1:1-3", "chr1:2-5", "chr2:0-1"], ref), ref)
    assert [int(r.value) for r in m.cover().dense().orderBy("contig", "pos").collect()] == [0, 1, 1, 1, 1, 0, 1, 0, 0, 0]
    other = mask.interval_mask(as_regions(spark, ["chr1:4-6"], ref), ref)
    assert [tuple(r) for r in mask.combine_masks(m, other, "and").collect()] == [("chr1", 4, 5)]
    assert sorted(tuple(r) for r in mask.combine_masks(m, other, "andnot").collect()) == [("chr1", 1, 4), ("chr2", 0, 1)]


def brute_view(table, labels, contig, start, end):
    """Rows (start, end, values) of runs on which all columns agree, base by base; None is missing."""
    out = []
    for p in range(start, end):
        state = tuple(table.get((contig, x, p)) for x in labels)
        if all(v is None for v in state):
            continue
        if out and out[-1][1] == p and out[-1][2] == state:
            out[-1] = (out[-1][0], p + 1, state)
        else:
            out.append((p, p + 1, state))
    return out


def test_view_equals_brute_force(spark, rng):
    """Runs of random lengths over many buckets, with NaN and gaps; a region from the middle of a run to the middle of another."""
    ref, rows, table = Reference([("one", 3000), ("two", 17)]), [], {}
    for contig in ref:
        for x in "uvw":
            p = 0
            while p < ref[contig]:
                n, v = min(rng.randrange(1, 90), ref[contig] - p), rng.choice([1.0, 1.0, 2.5, float("nan"), None, "gap"])
                if v != "gap":
                    cut = rng.randrange(1, n) if n > 1 else n  # two runs of one value that touch
                    rows += [(contig, a, b, x, v) for a, b in ((p, p + cut), (p + cut, p + n)) if a < b]
                    table |= {(contig, x, i): v for i in range(p, p + n) if v is not None and v == v}
                p += n
    track = Track(spark.createDataFrame(rows, "contig string, start long, end long, label string, value double"), ref, ("u", "v", "w"))
    asked = [("one", 0, 3000), ("two", 0, 17), ("one", 1111, 1777)]
    found = runs.view(track, as_regions(spark, asked, ref)).collect()
    for i, region in enumerate(asked):
        got = sorted((r.start, r.end, (r.u, r.v, r.w)) for r in found if r.region_id == i)
        assert got == brute_view(table, "uvw", *region)


def test_view_lines_and_rounding(spark):
    ref = Reference([("left", 12), ("right", 3)])
    t = Track(spark.createDataFrame([("left", 1, 3, "p", 2.25), ("left", 3, 4, "p", 2.35), ("left", 2, 6, "q", -2.5), ("right", 0, 1, "q", float("nan"))], "contig string, start long, end long, label string, value double"), ref, ("p", "q"))
    regions = as_regions(spark, ["right", "left:0-5"], ref)
    assert [r.value for r in runs.view_lines(runs.view(t, regions)).collect()] == ["left\t1\t2\t2.25\tNaN", "left\t2\t3\t2.25\t-2.5", "left\t3\t4\t2.35\t-2.5", "left\t4\t5\tNaN\t-2.5"]
    assert [tuple(r)[2:] for r in runs.view(t, regions, ["q"], 1).collect()] == [(2, 5, -3.0)]
    values = [0.5, 1.5, 2.5, -2.5, 0.25, 1e300, 5e-324, 0.0, 1e-310, 149.0, 150.0, float("inf")]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select(quantize(F.col("v"), 1).alias("q"))
    assert [r.q for r in frame.collect()] == pytest.approx([0.5, 2.0, 3.0, -3.0, 0.3, 1e300, 5e-324, 0.0, 1e-310, 100.0, 200.0, float("inf")], rel=1e-12, abs=0)
    with pytest.raises(ValueError):
        t.select(["s3"])


def test_missing_is_missing_everywhere(spark, track, dense):
    """NaN and NULL alike: totals, bins, windows and summits leave them out."""
    totals = {r.label: r for r in algebra.label_totals(track).collect()}
    assert totals["a"].total == pytest.approx(np.nansum(dense[:, 0])) and totals["b"].bases == np.isfinite(dense[:, 1]).sum()
    bins = {(r.contig, r.bin, r.label): r.value for r in algebra.binned(track, 10).collect()}
    assert bins["beta", 0, "b"] is None and bins["alpha", 2, "a"] == pytest.approx(np.nanmean(dense[20:30, 0]))
    rolled = {(r.contig, r.pos, r.label): r.value for r in algebra.rolling_mean(track, 5, block=16).collect()}
    assert all((v is None) == (not 2 <= p < REF[c] - 2 or bool(np.isnan(dense[OFFSET[c] + p - 2 : OFFSET[c] + p + 3, "ab".index(x)]).any())) for (c, p, x), v in rolled.items())
    best = {(r.region_id, r.label): r.summit_position for r in reduce.summit({"t": track}, as_regions(spark, INTERVALS, REF), "t").collect()}
    for (i, x), w in windows(dense).items():
        assert best.get((i, x), INTERVALS[i][1]) == INTERVALS[i][1] + (int(np.nanargmax(w)) if np.isfinite(w).any() else 0)
    assert Track(track.runs, REF, ("a", "b"), float("nan")).fill is None


def test_aggregates_across_labels(spark, dense, track):
    found = algebra.across_labels(track, most=F.max("value"), n=F.count("value")).collect()
    per = {(r.contig, p): (r.most, r.n) for r in found for p in range(r.start, r.end)}
    assert len(per) == REF.total == sum(r.end - r.start for r in found)
    for c in REF:
        for p in range(REF[c]):
            w = dense[OFFSET[c] + p]
            assert per[c, p] == (np.nanmax(w) if np.isfinite(w).any() else None, np.isfinite(w).sum())


def test_runs_and_islands_merge_over_buckets(spark, rng):
    """Intervals that touch, overlap and span many buckets, against a set of bases; runs likewise, whatever the bucket."""
    intervals = [(rng.choice("xy"), s, s + rng.choice([1, 3, 40, 200])) for s in (rng.randrange(2000) for _ in range(60))] + [("x", 64, 128), ("x", 128, 192), ("y", 0, 0)]
    df = spark.createDataFrame(intervals, "contig string, start long, end long")
    want = []
    for c in "xy":
        bases = sorted({p for k, s, e in intervals if k == c for p in range(s, e)})
        for p in bases:
            if want and want[-1][0] == c and want[-1][2] == p:
                want[-1] = (c, want[-1][1], p + 1)
            else:
                want.append((c, p, p + 1))
    for bucket in (4, 64, 1 << 16):
        assert sorted(tuple(r) for r in mask.coalesce_intervals(df, bucket).collect()) == want
    rows, p = [], 0
    for _ in range(300):
        n = rng.choice([1, 2, 70])
        rows.append(("x", p, p + n, "l", rng.choice([1, 1, 2, None])))
        p += n + rng.choice([0, 0, 0, 5])
    merged = []
    for r in rows:
        if merged and merged[-1][2] == r[1] and merged[-1][4] == r[4]:
            merged[-1] = (*merged[-1][:2], r[2], *r[3:])
        else:
            merged.append(r)
    frame = spark.createDataFrame(rows, "contig string, start long, end long, label string, value long")
    for bucket in (8, 64, 1 << 20):
        assert sorted(tuple(r) for r in runs.collapse(frame, bucket).collect()) == merged


def test_a_long_contig_is_no_one_task(spark):
    """A million runs of one contig: every window's rows spread over all partitions."""
    ref = Reference([("long", 1 << 30)])
    rows = spark.range(1_000_000).select(F.lit("long").alias("contig"), (F.col("id") * 1000).alias("start"), (F.col("id") * 1000 + 1000 - F.col("id") % 2).alias("end"), F.lit("").alias("label"), (F.col("id") % 3).alias("value"))
    merged = runs.collapse(rows, ref.bucket())
    sizes = [r["count"] for r in merged.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1_000_000 and max(sizes) < 600_000
    assert mask.coalesce_intervals(rows, ref.bucket()).count() == 500_000


def test_loci_by_label(spark, track):
    view = mask.region(track, "alpha:5-9").where("label = 'a'")
    at = lambda x: [r.pos for r in mask.select_loci(view, x).orderBy("pos").collect()]
    assert at("alpha:6") == [6] and at(slice("alpha:6", "alpha:8")) == [6, 7, 8] and at(slice(None, "alpha:6")) == [5, 6]
    assert [r.pos for r in mask.select_loci(view, ["alpha:8", "alpha:5"]).collect()] == [8, 5]
    for wrong in ("beta:6", "alpha:9", ["alpha:5", "alpha:x"]):
        with pytest.raises(KeyError):
            mask.select_loci(view, wrong)
    with pytest.raises(NotImplementedError):
        mask.select_loci(view, slice("alpha:5", "alpha:8", 2))


def test_combinations_refuse_other_references(spark, track):
    other = Track(track.runs, Reference([("gamma", 33), ("beta", 9), ("alpha", 61)]), ("a", "b"))
    with pytest.raises(ValueError):
        algebra.combine({"x": track, "y": other}, track.runs["value"])
    with pytest.raises(ValueError):
        algebra.concat([track, track])
