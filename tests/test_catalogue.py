"""Each registered query gives the rows of its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from loglattice import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in db.sql(f"select {', '.join(columns)} from ({catalogue.oracle_sql()[name]})").fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
