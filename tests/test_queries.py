"""Each query with SQL gives what DuckDB gives on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from lodestone.plans import catalog

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables")


def cell(x):
    if x is None or x is pd.NA or isinstance(x, float) and np.isnan(x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    return float(x) if isinstance(x, (int, float, np.number)) else str(x)


def rows(df):
    return sorted(repr([cell(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    got = __spark_entry__.queries()[name](spark, str(SF)).toPandas()
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert len(got)
        return
    con = duckdb.connect()
    for t in SF.glob("*.parquet"):
        con.sql(f"create view {t.stem} as select * from '{t}'")
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
