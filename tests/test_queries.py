"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from stallkeeper.plans import inventory, pricing, queries  # noqa: F401 (the others register more)

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(df):
    cell = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float, np.number)) else str(v)
    return sorted(map(str, (tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    found, expected = queries.QUERIES[name](spark, DIR).toPandas(), duck.execute(queries.SQL[name]).fetchdf()
    assert sorted(found.columns) == sorted(expected.columns)
    assert plain(found) == plain(expected)
