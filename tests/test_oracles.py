"""Every query of the engine that has SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from hushframe.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(sf + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return round(float(v), 6) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf, duck):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) > 0
    assert rows(got) == rows(want)
