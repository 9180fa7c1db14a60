import os

import duckdb
import pytest

import __spark_entry__ as entry
from spanwise.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def rows(columns, data):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(str(tuple(r[i] for i in at)) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_table_queries_drop_no_rows(spark, duck):
    """Counts taken from the plain tables, without the registered SQL."""
    got = registry.QUERIES["interval_coalesce"](spark, SF).selectExpr("sum(end - start)").first()[0]
    contig, start = "o_orderstatus || '-' || o_custkey % 251", "date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))"
    want = duck.sql(f"SELECT count(DISTINCT (c, p)) FROM (SELECT {contig} AS c, unnest(range({start}, {start} + 1 + o_orderkey % 30)) AS p FROM orders)").fetchall()[0][0]
    assert got == want
    assert registry.QUERIES["interval_mask_bases"](spark, SF).selectExpr("sum(masked)").first()[0] == want
    assert registry.QUERIES["bed_last_wins"](spark, SF).selectExpr("sum(bases)").first()[0] == want
    insertions = registry.QUERIES["pileup_composition"](spark, SF).where("kind = 'ins'").selectExpr("sum(n)").first()[0]
    assert insertions == duck.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    quantized = registry.QUERIES["quantized_runs"](spark, SF)
    assert quantized.selectExpr("sum(bases)").first()[0] == registry.depth_track(spark, SF).runs.where("value IS NOT NULL").selectExpr("sum(end - start)").first()[0]
    assert quantized.where("value >= 100").count() > 0 and quantized.where("value < 10").count() > 0
