"""Every query with SQL against DuckDB, the others for a stable schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from weftline.plans import queries as core


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_against_sql(spark, sf, duck, name):
    df = core.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*columns).collect())
    answer = duck.sql(core.ORACLE_SQL[name])
    assert sorted(answer.columns) == columns
    at = [answer.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert core.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["page_id", "title", "links", "nodes"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
