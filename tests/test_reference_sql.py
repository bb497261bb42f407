"""Every statement against the same in SQL, on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from docloom.queries import problems, reference

ALL = reference.QUERIES | problems.QUERIES
SQL = reference.SQL | problems.SQL


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    x = x.item() if hasattr(x, "item") else x
    return round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) else x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, con, name):
    got, want = ALL[name](spark, data).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
