import os

import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(n for n in contract.oracle_sql() if n.startswith("kv_")))
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    for table in TABLES:
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    relation = base.execute(contract.oracle_sql()[name])
    names = [c[0] for c in relation.description]
    want = sorted((tuple(map(str, r)) for r in relation.fetchall()))
    got = contract.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(map(str, r)) for r in got.select(names).collect()) == want
