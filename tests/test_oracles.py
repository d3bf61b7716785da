"""Every query of the engine that has SQL gives the same rows as DuckDB."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from foliospark.plans import catalog


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    expected = duck.sql(catalog.ORACLES[name])
    columns = sorted(expected.columns)
    assert columns == sorted(df.columns)
    at = [expected.columns.index(c) for c in columns]
    mine = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(norm(r[i]) for i in at) for r in expected.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
