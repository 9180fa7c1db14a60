import json
import os
import re
import time

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from spanwise import api
from spanwise.operators import pileup, reduce
from spanwise.plans.reference import Reference
from spanwise.plans.track import Track, as_regions
from spanwise.sources import store, text
from spanwise.streaming.append import append_stream, watch_runs

REF = Reference([("chr1", 20)])
RUNS = "contig string, start long, end long, label string, value double"


def save(path, content):
    path.write_text(content)
    return str(path)


def test_bed_shapes(spark, tmp_path):
    mixed = save(tmp_path / "mixed.bed", "#chrom\tstart\tend\tcoverage\tscore\tis_max\nchr1\t0\t10\t4\t1.5\ttrue\nchr1\t10\t30\t9\t-2.5\tfalse\nchrX\t0\t5\t1\t1\ttrue\n")
    assert [(c.track, c.dtype) for c in text.bed_schema(spark, mixed)] == [("coverage", "uint8"), ("score", "float32"), ("is_max", "bool")]
    tracks = text.import_bed(spark, [(mixed, "m")], REF)
    assert [tuple(r) for r in tracks["coverage"].runs.orderBy("start").collect()] == [("chr1", 0, 10, "m", 4), ("chr1", 10, 20, "m", 9)]
    plain = save(tmp_path / "plain.bed", "chr1\t2\t5\n")
    assert text.import_bed(spark, [(plain, "p")], REF)["mask"].fill is False
    four = save(tmp_path / "four.bed", "chr1\t0\t10\t1\nchr1\t5\t8\t2\n")
    got = text.import_bed(spark, [(four, "f")], REF)["four"].runs.orderBy("start").collect()
    assert [(r.start, r.end, r.value) for r in got] == [(0, 5, 1), (5, 8, 2), (8, 10, 1)]


def test_inferred_types():
    pick = lambda lo, hi, exact=True, **k: text.infer_dtype(lo, hi, False, True, exact, **k)
    assert [pick(0, 254), pick(0, 255), pick(0, 255, fill=0), pick(-1, 126), pick(-1, 127), pick(0, 70000)] == ["uint8", "uint16", "uint8", "int8", "int16", "uint32"]
    assert [pick(0, 1), pick(0, 1, fill=None), pick(0, 1, exact=False), pick(0, 9, exact=False), pick(0, 2**31 - 1, exact=False), pick(0, 2**31 - 1, exact=False, fill=0)] == ["bool", "uint8", "int32", "int32", "uint32", "int32"]
    assert text.infer_dtype(0, 1, True, True, False) == "bool" and text.infer_dtype(None, None, False, False, True, wide=True) == "float64"
    for wrong in ((0, 2, True, True, True), (0, 2**32, False, True, True), (-1, 2**31, False, True, True)):
        with pytest.raises(ValueError):
            text.infer_dtype(*wrong)


def test_bed_schema_over_all_files(spark, tmp_path):
    """Types that hold the cells of every file, of samples or of all; schemas as TSV; one wide track; refusals."""
    head = "#chrom\tstart\tend\ta\tb\n"
    one = save(tmp_path / "one.bed", head + "chr1\t0\t4\t7\t1\nchr1\t4\t6\t8\t0\n")
    two = save(tmp_path / "two.bed", head + "chr1\t0\t2\t300\t1\nchr1\t2\t3\t-1\t1\n")
    kinds = lambda *p, **k: [(c.track, c.dtype) for c in text.bed_schema(spark, list(p), **k)]
    assert kinds(one) == [("a", "uint8"), ("b", "bool")] and kinds(one, two) == [("a", "int16"), ("b", "bool")]
    assert kinds(one, infer_rows=1) == [("a", "int32"), ("b", "int32")] and kinds(one, infer_rows=None, fill=None) == [("a", "uint8"), ("b", "uint8")]
    assert kinds(two, fields=["b"]) == [("b", "bool")]
    tracks = text.import_bed(spark, [(one, "x"), (two, "y")], REF)
    got = sorted((r.label, r.start, r.end, r.value) for r in tracks["a"].runs.collect())
    assert got == [("x", 0, 4, 7), ("x", 4, 6, 8), ("y", 0, 2, 300), ("y", 2, 3, -1)] and tracks["a"].labels == ("x", "y")
    wide = text.import_bed(spark, [(two, "y")], REF, track="both", dim="kind")["both"]
    assert (wide.labels, wide.dim) == (("a", "b"), "kind") and sorted((r.label, r.start, r.value) for r in wide.runs.collect()) == [("a", 0, 300), ("a", 2, -1), ("b", 0, 1)]
    columns = text.bed_schema(spark, [one, two], fill=0)
    again = text.read_schema(spark, save(tmp_path / "schema.tsv", text.emit_schema(columns)))
    assert again == columns and [c.gap for c in again] == [0, 0]
    picked = text.import_bed(spark, [(one, "x")], REF, [text.Column("4", "fourth", "float32"), text.Column("b", "flag", "bool")])
    assert sorted(picked) == ["flag", "fourth"] and picked["flag"].fill is False and picked["fourth"].fill is None
    for wrong in ([text.Column("c", "t")], [text.Column("2", "t")], [text.Column("a", "t"), text.Column("b", "t"), text.Column("4", "u")], [text.Column("a", "t"), text.Column("a", "u")]):
        with pytest.raises(ValueError):
            text.import_bed(spark, [(one, "x")], REF, wrong)
    with pytest.raises(ValueError, match="single source"):
        text.import_bed(spark, [(one, "x"), (two, "y")], REF, track="t")
    with pytest.raises(Exception, match="bad cell of t on line 2"):
        text.import_bed(spark, [(two, "y")], REF, [text.Column("a", "t", "uint8")])["t"].runs.collect()
    mixed = save(tmp_path / "mixed.bed", head + "chr1\t0\t4\ttrue\t1\nchr1\t4\t6\t8\tnan\n")
    for column in ("a", "b"):
        with pytest.raises(ValueError):
            text.bed_schema(spark, mixed, fields=[column])
    assert [text.parse_fill(x) for x in (None, "na", "true", "3", "4.0", "0.5")] == [text.UNSET, None, True, 3, 4, 0.5]


def test_line_numbers_past_the_first_split(spark, tmp_path):
    path = save(tmp_path / "long.txt", "".join(f"row {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = text.lines(spark, path)
        assert found.rdd.getNumPartitions() > 4
        assert all(r.value == f"row {r.line}" for r in found.collect()) and found.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_last_line_wins(spark, rng):
    rows = [("chr1", s, s + rng.randrange(1, 300), rng.choice("ab"), rng.randrange(5), i) for i, s in enumerate(rng.randrange(900) for _ in range(80))]
    want = {}
    for c, s, e, x, v, _ in rows:
        want |= {(c, x, p): v for p in range(s, e)}
    for bucket in (16, 1 << 16):
        got = text.last_wins(spark.createDataFrame(rows, "contig string, start long, end long, label string, value long, line long"), bucket).collect()
        assert {(r.contig, r.label, p): r.value for r in got for p in range(r.start, r.end)} == want
        assert sum(r.end - r.start for r in got) == len(want)


def test_small_parsers(spark, tmp_path):
    assert text.parse_source("a/b.bed:x") == ("a/b.bed", "x") and text.parse_source("s3://a/b") == ("s3://a/b", None)
    assert text.default_label("d/reads.bed.gz") == "reads"
    assert text.read_fai(spark, save(tmp_path / "a.fai", "chr2\t5\t0\nchr1\t3\t0\n\n")).lengths == (5, 3)
    bad = save(tmp_path / "bad.bed", "chr1\t5\t25\n")
    with pytest.raises(Exception, match="line 1"):
        text.read_regions(spark, bad, REF).collect()


def test_store(spark, tmp_path):
    path = str(tmp_path / "s")
    st = store.create(spark, path, REF)
    with pytest.raises(FileExistsError):
        store.create(spark, path, REF)
    one = Track(spark.createDataFrame([("chr1", 0, 5, "a", 2.0)], RUNS), REF, ("a",), 0.0)
    st.write({"depth": one, "other": one})
    with pytest.raises(FileExistsError):
        st.write({"depth": one})
    with pytest.raises(ValueError):
        st.write({"contig": one})
    st.append("depth", Track(spark.createDataFrame([("chr1", 0, 10, "b", 4.0)], RUNS), REF, ("b",), 0.0))
    again = store.open_store(spark, path)
    assert again["other"].labels == ("a", "b")
    got = reduce.reduce_regions(again["other"], as_regions(spark, "chr1", REF), "sum").orderBy("ord").collect()
    assert [r.value for r in got] == [10.0, 0.0]
    assert store.validate(spark, path) == ("valid", []) and store.validate(spark, path + "x")[0] == "incomplete"
    assert again.info()["tracks"]["depth"]["bytes"] > 0
    with pytest.raises(ValueError):
        store.open_store(spark, path, tracks=["nope"])


def sums(store_path, spark, name="depth"):
    t = store.open_store(spark, store_path)[name]
    return {r.label: r.s for r in t.runs.groupBy("label").agg(F.sum(F.col("value") * (F.col("end") - F.col("start"))).alias("s")).collect()}


def test_stream_appends_each_label_once(spark, tmp_path):
    path, folder = str(tmp_path / "s"), str(tmp_path / "in")
    store.create(spark, path, REF).write({"depth": Track(spark.createDataFrame([("chr1", 0, 5, "a", 2.0)], RUNS), REF, ("a",), 0.0)})
    new = spark.createDataFrame([("chr1", 0, 3, "b", 1.0)], RUNS)
    for k in range(2):
        new.write.mode("append").parquet(folder)
        append_stream(watch_runs(spark, folder), path, "depth", str(tmp_path / f"c{k}")).awaitTermination()
    t = store.open_store(spark, path)["depth"]
    assert t.labels == ("a", "b") and t.runs.where("label = 'b'").agg(F.sum(F.col("end") - F.col("start"))).first()[0] == 3


def test_stream_takes_a_label_in_two_batches(spark, tmp_path):
    """Later rows of a label join it, the bases that arrive again take their later value, and a replayed batch does nothing."""
    path, folder, check = str(tmp_path / "s"), str(tmp_path / "in"), str(tmp_path / "c")
    store.create(spark, path, REF).write({"depth": Track(spark.createDataFrame([("chr1", 0, 5, "a", 2.0)], RUNS), REF, ("a",), 0.0)})
    for rows in ([("chr1", 0, 3, "b", 1.0)], [("chr1", 10, 12, "b", 4.0), ("chr1", 2, 3, "b", 0.0), ("chr1", 4, 6, "a", 7.0)]):
        spark.createDataFrame(rows, RUNS).write.mode("append").parquet(folder)
        append_stream(watch_runs(spark, folder), path, "depth", check).awaitTermination()
        if rows[0][3] == "b" and len(rows) == 1:
            assert sums(path, spark) == {"a": 10.0, "b": 3.0}
    assert sums(path, spark) == {"a": 8.0 + 14.0, "b": 2.0 + 8.0}
    st = store.open_store(spark, path, read_only=False)
    again = Track(spark.createDataFrame([("chr1", 0, 20, "b", 9.0)], RUNS), REF, ("b",), 0.0)
    assert not st.append("depth", again, (check, 1)) and not st.append("depth", again, (check, 0)) and sums(path, spark)["b"] == 10.0
    st.compact("depth")
    assert sums(path, spark) == {"a": 22.0, "b": 10.0} and store.validate(spark, path) == ("valid", [])
    with pytest.raises(ValueError):
        st.append("depth", again)


def test_crash_before_the_metadata_changes_nothing(spark, tmp_path, monkeypatch):
    """What was written by a change that never reached the metadata is read by nobody; the change can be made again."""
    path = str(tmp_path / "s")
    st = store.create(spark, path, REF)
    st.write({"depth": Track(spark.createDataFrame([("chr1", 0, 5, "a", 2.0)], RUNS), REF, ("a",), 0.0)})
    more = Track(spark.createDataFrame([("chr1", 0, 3, "b", 1.0)], RUNS), REF, ("b",), 0.0)

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "_write_meta", crash)
        m.setattr(store, "delete", lambda *_: None)  # a real crash cleans nothing up
        with pytest.raises(KeyboardInterrupt):
            st.append("depth", more)
    assert sums(path, spark) == {"a": 10.0} and store.validate(spark, path) == ("valid", [])
    st = store.open_store(spark, path, read_only=False)
    st.append("depth", more)
    assert sums(path, spark) == {"a": 10.0, "b": 3.0}
    for name in ("bin_0", "bin_01", "bin_x", "position"):
        with pytest.raises(ValueError):
            st.write({name: more})


def test_validation_names_the_rule(spark, tmp_path):
    path = str(tmp_path / "s")
    store.create(spark, path, REF).write({"depth": Track(spark.createDataFrame([("chr1", 0, 5, "a", 2.0)], RUNS), REF, ("a",), 0.0)})
    meta = json.loads((tmp_path / "s" / store.META).read_text())

    def status(**changes):
        changed = json.loads(json.dumps(meta))
        track = changes.pop("track", {})
        changed |= changes
        if isinstance(changed["tracks"], dict) and "depth" in changed["tracks"]:
            changed["tracks"]["depth"] |= track
        store.replace_file(spark, f"{path}/{store.META}", json.dumps(changed))
        state, found = store.validate(spark, path)
        return state, [x.split(":")[0] for x in found]

    assert status(version="0") == ("unsupported_version", ["R1"])
    assert status(reference=[]) == ("invalid", ["R2"]) and status(reference=[["a", 1], ["a", 2]]) == ("invalid", ["R4"])
    assert status(reference=[["a", 1.5]]) == ("invalid", ["R5"]) and status(reference=[["a", -1]]) == ("invalid", ["R6"])
    assert status(track={"labels": ["a", "a"]}) == ("invalid", ["D3"]) and status(track={"dim": "bin_4"}) == ("invalid", ["G3"])
    assert status(tracks={"bin_x": meta["tracks"]["depth"]}) == ("invalid", ["G1"]) and status(tracks={"depth": {}}) == ("invalid", ["D1"])
    assert status(tracks={"depth": meta["tracks"]["depth"], "o": meta["tracks"]["depth"] | {"labels": ["b"]}}) == ("invalid", ["D2"])
    assert status(track={"dtype": "string", "fill": None})[1] == ["encoding", "encoding"] and status(track={"fill": True}) == ("invalid", ["encoding"])
    assert status(track={"folders": ["nowhere"]})[0] == "incomplete" and status() == ("valid", [])


def test_layout_and_cancelled_writes(spark, tmp_path):
    """Files of few runs; a write that is cancelled half way leaves the store as it was."""
    path = str(tmp_path / "s")
    st = store.create(spark, path, REF)
    many = Track(spark.range(20).selectExpr("'chr1' AS contig", "id AS start", "id + 1 AS end", "'' AS label", "id AS value"), REF)
    st.write({"few": many}, file_rows=5, compression="snappy")
    files = [f for f in os.listdir(f"{path}/{st.meta['tracks']['few']['folders'][0]}") if f.endswith(".parquet")]
    assert len(files) >= 4 and all("snappy" in f for f in files) and st["few"].runs.count() == 20
    with pytest.raises(ValueError):
        st.write({"none": many}, file_rows=0)
    endless = F.udf(lambda x: time.sleep(60) or x, "long")
    slow = Track(many.runs.withColumn("value", endless("value")), REF)
    failed = []

    def run():
        try:
            with api.job(spark, "import"):
                st.write({"slow": slow})
        except Exception as e:
            failed.append(e)

    worker = InheritableThread(target=run)
    worker.start()
    time.sleep(4)
    api.cancel(spark, "import")
    worker.join(30)
    assert failed and not worker.is_alive() and store.open_store(spark, path).names == ["few"]
    assert not os.path.exists(f"{path}/slow") or not os.listdir(f"{path}/slow")


def test_zip_round_trip(spark, tmp_path):
    path, packed = str(tmp_path / "s"), str(tmp_path / "s.zip")
    store.create(spark, path, REF).write({"depth": Track(spark.createDataFrame([("chr1", 0, 5, "a", 2.0)], RUNS), REF, ("a",), 0.0)})
    store.pack(spark, path, packed)
    st = store.open_zip(spark, packed, str(tmp_path / "un"))
    assert st.reference == REF and sums(st.path, spark) == {"a": 10.0} and st["depth"].fill == 0.0
    with pytest.raises(store.StoreError):
        st.write({"more": st["depth"]})
    with pytest.raises(FileExistsError):
        store.pack(spark, path, packed)
    with pytest.raises(store.StoreError):
        store.open_zip(spark, save(tmp_path / "no.zip", "plain"), str(tmp_path / "un"))


SAM = """@SQ\tSN:ref1\tLN:60
r1\t99\tref1\t6\t60\t10M\t=\t11\t15\tACGTACGTAC\tIIIIIIIIII
r1\t147\tref1\t11\t60\t10M\t=\t6\t-15\tCCCCCCCCCC\tIIIIIIIIII
r2\t0\tref1\t21\t5\t4M2D4M2I4M\t*\t0\t0\tAAAACCCCTTGGGG\t*
r3\t1024\tref1\t1\t60\t5M\t*\t0\t0\tAAAAA\tIIIII
"""


def test_pileup(spark, tmp_path):
    ref, reads = text.read_sam(spark, save(tmp_path / "a.sam", SAM))

    def depth(**k):
        runs = pileup.depth(reads, ref, pileup.PileupOptions(**k)).dense().collect()
        return {r.pos: r.value for r in runs}

    plain = depth(mates="none")
    assert plain[10] == 2 and plain[5] == 1 and plain[26] == 1 and 26 not in depth(mates="none", min_mapq=10)
    assert 24 not in plain and depth(mates="none", count_deletions=True)[24] == 1
    deduped = depth(mates="proper")
    assert all(deduped[p] == 1 for p in range(5, 20))
    both = {r.pos: r for r in pileup.composition(reads).collect()}
    assert (both[24]["del"], both[29]["ins"], both[5].a, both[6].c) == (1, 1, 1, 1)
    assert both[12].t == 1 and both[12].c == 0  # the first mate's base stays
    assert {p: v for p, v in depth(mates="none", min_base_quality=1).items()} == plain


def brute_depth(reads, mates, count_deletions):
    """Depth base by base, as the mates' claims say: a dictionary for each pair."""
    depth, claims = {}, {}
    for name, flag, start, cigar, mate_start in reads:
        ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        span = sum(n for n, op in ops if op in "M=XDN")
        able = mates != "none" and name != "*" and flag & 0x901 == 1 and not flag & 8 and (mates == "all" or flag & 2)
        held = claims.pop(name, None) if able else None
        parks = able and held is None and name not in claims and start <= mate_start < start + span
        own, at = {"base": set(), "event": set()}, start
        for n, op in ops:
            if op in "M=X":
                for p in range(at, at + n):
                    own["base"].add(p)
                    if held is None or p not in held["base"]:
                        depth[p] = depth.get(p, 0) + 1
                at += n
            elif op in "DN":
                for p in range(at, at + n):
                    own["event"].add(p)
                    if op == "D" and count_deletions and (held is None or p not in held["event"]):
                        depth[p] = depth.get(p, 0) + 1
                at += n
            elif op == "I":
                own["event"].add(max(at - 1, start))
        if parks:
            claims[name] = own
        elif able and held is None:
            claims[name] = {"base": set(), "event": set()}  # the pair's turn is over
    return depth


def test_depth_by_segments_equals_brute_force(spark, rng):
    """Random pairs and single reads with all kinds of operations, in all mate modes."""
    reads, line = [], []
    for i in range(120):
        cigars = ["".join(f"{rng.randrange(1, 6)}{op}" for op in rng.choice(["M", "MDM", "SMIM", "MNM", "MDMIM", "=XM", "IMD", "MIDM"])) for _ in (0, 1)]
        starts = sorted(rng.randrange(60) for _ in (0, 1))
        flags = rng.choice([(0x1 | 0x2, 0x1 | 0x2), (0x1, 0x1), (0x1 | 0x2 | 0x8, 0x1 | 0x2), (0x1 | 0x2 | 0x100, 0x1 | 0x2), (0, 0)])
        name = rng.choice([f"r{i}", f"r{i}", "*"])
        for k in (0, 1)[: rng.choice([1, 2, 2, 2])]:
            reads.append((name, flags[k], starts[k], cigars[k], starts[1 - k]))
    reads.sort(key=lambda r: r[2])
    line = [(n, f, "chr1", s, 60, c, m, True, "*", "*", "", i) for i, (n, f, s, c, m) in enumerate(reads)]
    frame = spark.createDataFrame(line, "qname string, flag int, contig string, start int, mapq int, cigar string, mate_start int, same_contig boolean, seq string, qual string, label string, line long")
    ref = Reference([("chr1", 200)])
    for mates in pileup.MATES:
        for count in (False, True):
            options = pileup.PileupOptions(exclude_flags=4, mates=mates, count_deletions=count)
            got = {r.pos: r.value for r in pileup.depth(frame, ref, options).dense().collect()}
            assert got == brute_depth(reads, mates, count), (mates, count)
            kinds = ("a", "c", "g", "t", "n", *(["del"] if count else []))
            slow = {r.pos: r.n for r in pileup.events(frame, options).where(F.col("kind").isin(*kinds)).groupBy("pos").agg(F.count("pos").alias("n")).collect()}
            assert got == slow


def test_very_long_cigar(spark):
    """Offsets of 20,000 operations, which sums of sixty-four keep cheap."""
    cigar, ref_at, query_at, want = "", 0, 0, []
    for i in range(20_000):
        n, op = i % 3 + 1, "MIDS"[i % 4] if i % 4 != 3 else "M"
        want.append((ref_at, query_at))
        ref_at, query_at, cigar = ref_at + n * (op in "MD"), query_at + n * (op in "MI"), cigar + f"{n}{op}"
    frame = spark.createDataFrame([(cigar,)], "cigar string")
    got = pileup.cigar_steps(frame).select("ref_at", "query_at", "span").collect()
    assert [(r.ref_at, r.query_at) for r in got] == want and got[0].span == ref_at
