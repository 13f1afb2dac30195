"""Every named query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from folioframe.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def rows(frame: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "NULL"
        return f"{float(v):.6g}" if not isinstance(v, (str, bytes)) else v

    return sorted(tuple(value(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(ORACLE)):
        assert QUERIES[name](spark, SF).count() > 0
