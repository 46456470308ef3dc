"""Every query with SQL gives the rows of that SQL in DuckDB, on the smallest of the given tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)


def test_every_query_with_sql_has_a_function():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = {c: i for i, c in enumerate(want.columns)}
    expected = sorted((tuple(plain(r[at[c]]) for c in columns) for r in want.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str) == expected


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
