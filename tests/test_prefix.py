"""Versions by prefix: what an aggregate to one version a key would drop."""

import pytest

import __spark_entry__ as contract
from kvspark.operators import resolve
from kvspark.schema import LOG

BLOG, SHOP = "https://blog.a.org/x", "https://shop.a.org/x"


def test_pages_that_share_a_url_all_stay(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, BLOG), (2, SHOP), (7, BLOG), (7, BLOG), (9, f"{BLOG}/é"), (11, None), (12, "https://blog"), (13, ""), (None, BLOG)]
    spark.createDataFrame([(*r, "") for r in rows], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = base.execute(contract.oracle_sql()["kv_pages_prefix"]).fetchall()
    got = [(r.url, r.seq) for r in contract.queries()["kv_pages_prefix"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 5


def test_versions_come_newest_first(spark):
    log = spark.createDataFrame([(b"ab", 1, 1, b"x"), (b"ab", 3, 0, None), (b"a", 2, 1, b"y"), (b"b", 4, 1, b"z"), (b"ac", 5, 1, b"w")], LOG)
    rows = resolve.prefix_versions(log, b"a", as_of=4)
    assert [(bytes(r.key), r.seq) for r in rows.collect()] == [(b"a", 2), (b"ab", 3), (b"ab", 1)]
    assert [bytes(r.key) for r in resolve.prefix_scan(log, b"a").collect()] == [b"a", b"ac"]
