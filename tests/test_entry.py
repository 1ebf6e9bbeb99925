"""The driver contract: names, schemas and the SQL of every query that has one, on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("LOOMSPACE_TESTDATA", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = sorted(n for n in QUERIES if n in SQL)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 150


def plain(frame: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if isinstance(x, (list, np.ndarray)):
            return tuple(map(cell, x))
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
            return "~"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (float, np.floating)) and not float(x).is_integer():
            return f"{x:.5f}"
        return str(int(x)) if isinstance(x, (int, float, np.integer, np.floating)) else str(x)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
