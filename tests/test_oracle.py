"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

from threatweave.plans import registry
from threatweave.plans.domain import GIVEN

from .conftest import SF


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_sql_has_its_query():
    assert set(registry.SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 150


@pytest.mark.parametrize("name", sorted(registry.SQL)[::5])
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = oracle.sql(registry.SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
