"""The entry module: every query with SQL agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from spanforge.plans.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    con.sql("SET TimeZone = 'UTC'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, D).toArrow()
    names = sorted(got.column_names)
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").to_arrow_table()
    rows = lambda t: sorted(map(repr, zip(*[t.column(c).to_pylist() for c in names], strict=True)))
    assert rows(got) == rows(want)
    assert [str(got.schema.field(c).type) for c in names] == [str(want.schema.field(c).type) for c in names]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, D).count() > 0
