"""Every registered query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math
import os

import pandas as pd
import pytest

from tremorlake.plans import all_queries, all_sql

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return int(v) if v.is_integer() else float(f"{v:.8g}")
    return str(v) if isinstance(v, pd.Timestamp) else v


def _rows(df):
    return sorted((tuple(_plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got, want = all_queries()[name](spark, DATA).toPandas(), duck.sql(all_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_runs_without_sql(spark, name):
    assert all_queries()[name](spark, DATA).count() > 0
