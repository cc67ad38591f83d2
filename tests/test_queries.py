"""Every core query with SQL gives the same rows on the smallest test tables."""

import glob
import os
import sys

import pytest

ROOT = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))


def core():
    import importlib

    import __spark_entry__ as e

    found = [importlib.import_module(f"loomaudit.plans.{n}") for n in e.PLANS]
    return {k: (m.QUERIES[k], m.SQL[k]) for m in found for k in m.SQL}


def rows(frame):
    import pandas as pd

    show = lambda v: "NULL" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.8g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core()))
def test_same_as_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in glob.glob(f"{ROOT}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    q, sql = core()[name]
    assert rows(q(spark, ROOT).toPandas()) == rows(c.sql(sql).df())
