"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidemark import catalogue

SQL = catalogue.oracle_sql()
ROWS_ONLY = sorted(set(catalogue.queries()) - set(SQL))


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    names = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    done = duck.execute(SQL[name])
    have = [c[0] for c in done.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    assert found == sorted((tuple(plain(r[i]) for i in at) for r in done.fetchall()), key=repr)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() >= 0
