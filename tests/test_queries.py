"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from podium.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def cells(rows, names):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return x if isinstance(x, (str, bool)) else float(x)

    return sorted((tuple(one(r[names.index(n)]) for n in sorted(names)) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert cells([tuple(r) for r in got.collect()], got.columns) == cells(want.fetchall(), names)
