"""Every query with an SQL text gives the same rows as that text in another engine."""

import decimal
import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E

SQL = E.oracle_sql()
NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return None if not isinstance(v, (list, dict)) and pd.isna(v) else (round(v, 6) if isinstance(v, float) else v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    got = E.queries()[name](spark, sf).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark, sf):
    assert E.entry(spark).count() >= 0
