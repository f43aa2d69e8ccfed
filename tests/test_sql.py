"""Every core query with SQL gives the same rows as DuckDB over the same tables."""

import math

import duckdb
import pytest

from crease.plans.queries import QUERIES, SQL

from .conftest import DATA


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view \"{p.stem}\" as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    at = [rel.columns.index(c) for c in order]
    ours = sorted(str([plain(r[c]) for c in order]) for r in df.collect())
    theirs = sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert ours == theirs


def test_no_sql_without_a_query():
    assert set(SQL) <= set(QUERIES)
