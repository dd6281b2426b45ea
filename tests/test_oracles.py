"""Every query with SQL gives what DuckDB gives on the smallest tables; the others run."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__

# The queries of a subpackage that may be absent are tested beside it.
CORE = [n for n, f in __spark_entry__.queries().items() if ".plans." in f.__module__]


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].map(lambda v: isinstance(v, (list, np.ndarray))).any():
            df[c] = df[c].map(lambda v: None if v is None else str(list(v)))
        elif pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float).round(4)
    df = df.astype(object).where(df.notna(), None)
    return sorted(map(tuple, df.values.tolist()), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(small + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, small, duck, name):
    got = __spark_entry__.queries()[name](spark, small).toPandas()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark, small):
    assert __spark_entry__.entry(spark).count() >= 0
