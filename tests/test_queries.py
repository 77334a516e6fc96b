"""Every registered query runs, and tells the same rows as its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query(spark, sf_dir, duck, name):
    df = entry_module.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    sql = entry_module.oracle_sql().get(name)
    if sql:
        told = duck.sql(sql)
        assert sorted(told.columns) == sorted(df.columns)
        at = [told.columns.index(c) for c in df.columns]
        want = sorted((tuple(plain(r[i]) for i in at) for r in told.fetchall()), key=repr)
        assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
