"""The queries that SQL can express give the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from hushframe.llm.queries import QUERIES
from hushframe.llm.sql import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted(repr(tuple(None if pd.isna(v) else v for v in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert [x.replace(".0", "") for x in plain(got)] == [x.replace(".0", "") for x in plain(want)]
