"""Every registered query runs; those with SQL agree with DuckDB, value by value."""

import os

import duckdb
import pytest

from tidewright import queries as engine

QUERIES, ORACLE = engine.queries(), engine.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got.columns)
    if name not in ORACLE:
        return
    want = con.execute(ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    for c in cols:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), (c, a[c][~same].head().tolist(), b[c][~same].head().tolist())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["l_orderkey", "l_linenumber", "I"]
    assert set(e.oracle_sql()) <= set(e.queries())
