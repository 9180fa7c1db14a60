import json

import pytest

import corpus_pipeline
from spanwise.llm import decontaminate, jaccard, shared, toxicity

from .test_models import corpus
from .test_text_operators import brute, row_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, `slot` long, __toxic string, __key int, __id int, __tokens int, __copies int, __size int, __part int"


def test_pipeline(spark):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).cache()
    assert out.columns == [*before.columns, "shard", "slot"]
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert len(ids) > 0.6 * before.count()
    # The result holds no near copies, no contaminated and no toxic documents.
    one = out.dropDuplicates(["doc_id"])
    assert jaccard.shingle_components(one).where("doc_id <> component_id").count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contamination_report(one, bench).where("contaminated").count() == 0


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


@pytest.fixture
def folder(spark, rng, tmp_path):
    """Documents with all that is odd, as tables of a folder: (path, rows, benchmark items)."""
    texts, labels = corpus(rng, 260)
    rows = [(i, f"{text} {' '.join(f'v{rng.randrange(900)}' for _ in range(25))}", lang) for i, text, lang in texts]
    bench = [(k, " ".join(f"q{rng.randrange(500)}" for _ in range(18))) for k in range(5)] + [(5, None), (6, "")]
    word = lambda i: rows[i][1].split()
    near = [*word(20)[:-1], "other"]
    rows += [(1000, rows[1][1]), (1001, rows[1][1].upper()), (1002, " ".join(near)), (5000, rows[2][1]), (5000, "a text of its own under an id that has a copy too " + " ".join(word(3)[:9]))]
    rows += [(5001, "said three times " + " ".join(word(4)[::-1]))] * 3 + [(6000, None), (6000, None), (6001, ""), (None, "no id " + " ".join(word(5)[::-1])), (None, rows[8][1])]
    rows += [(7000 + k, f"{' '.join(word(9 + k)[:20])} {bench[k][1]}") for k in range(3)] + [(7100, " ".join(f"u{rng.randrange(10**6)}" for _ in range(40_000)) + " " + bench[0][1])]
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "en") for r in rows]
    path = str(tmp_path / "tables")
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), "mine", 3, "x", 1, 2, 3, 4, 5, 6) for i, t, lang in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, bench


def kept_by_brute_force(rows, toxic, bench):
    """(doc_id, text) that stay: not toxic, first of their near copies by all pairs, not contaminated by all windows."""
    left = [(i, t) for i, t, _ in rows if (i, t) not in toxic]
    found = set()
    for (i, t), (_, n, least) in zip(left, row_components(left), strict=True):
        if i is None or n == 0 or i == least:
            found.add((i, t))
    found = sorted(found, key=str)
    return {x for x in found if not brute([x], bench)[0][5]}


def test_pipeline_equals_brute_force(spark, folder):
    path, rows, bench = folder
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.fit_labelled(docs, labels)
    toxic = {(r.doc_id, r.text) for r in toxicity.score(docs.select("doc_id", "text"), model).where("score >= 0.5").collect()}
    assert 20 < len(toxic) < 60
    want = kept_by_brute_force(rows, toxic, bench)
    out = corpus_pipeline.run(spark, path)
    assert out.columns == [*docs.columns, "_shard", "_slot"]
    got = out.collect()
    assert {(r.doc_id, r.text) for r in got} == want
    assert all((r["shard"], r["slot"], r["__toxic"], r["__copies"], r["__part"]) == ("mine", 3, "x", 4, 6) for r in got)
    assert sum(r.doc_id == 6000 for r in got) == 2 and sum(r.doc_id is None for r in got) == 2 and (5000, rows[2][1]) not in want
    for k in {r["_shard"] for r in got}:
        assert sorted(r["_slot"] for r in got if r["_shard"] == k) == list(range(sum(r["_shard"] == k for r in got)))
    # Only the result is left of what the stages wrote.
    assert json.loads(json.dumps(shared.Scratch.open)) == []


def test_pipeline_without_labels_or_benchmark(spark, folder, tmp_path):
    path, rows, _ = folder
    bare = str(tmp_path / "bare")
    for name, part in (("documents", None), ("labels", 0), ("benchmark", 0)):
        df = spark.read.parquet(f"{path}/{name}.parquet")
        (df if part is None else df.limit(0)).write.parquet(f"{bare}/{name}.parquet")
    got = corpus_pipeline.run(spark, bare).select("doc_id", "text").collect()
    assert {(r.doc_id, r.text) for r in got} == kept_by_brute_force(rows, {None}, [])
