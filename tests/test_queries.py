"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexloom.plans.oracle import ORACLE
from lexloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "events", "pages", "labels", "benchmark", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    cols = sorted(found.columns)
    want = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({ORACLE[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in found.select(*cols).collect()))) == sorted(map(repr, want))
