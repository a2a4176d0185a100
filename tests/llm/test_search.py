"""Exact top-k search."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.llm import topk
from podium.llm.queries import op7_top_k

from .conftest import DATA

KIND = "vec_id long, embedding array<float>, label int, score string, rank string"


def brute(rows, k):
    usable = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % 20 == 0}):
        e = next(v for i, v in usable if i == q)
        best = sorted((-sum(a * b for a, b in zip(e, v)), i) for i, v in usable if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash") for i, v, *_ in rows], KIND)


NUMBER = st.one_of(st.sampled_from([0.0, 0.5, -0.5, 1.0, float("nan"), float("inf"), None, -0.01]), st.floats(-3, 3, width=32))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(NUMBER, min_size=0, max_size=3)), max_size=45), st.integers(1, 25))
def test_small(spark, vectors, k):
    rows = list(enumerate(vectors)) + [(None, [1.0])]
    got = topk.top_k(frame(spark, rows), k=k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, k)


@pytest.mark.parametrize(("scale", "n"), [(1, 700), (10_000, 300), (1e6, 260)])
def test_pruning_is_exact(scale, n):
    """Clustered vectors, where most candidates are outsiders after a part of the lists; large numbers too."""
    rng = np.random.default_rng(0)
    c = (rng.normal(size=(n, 16)) * 10 + 100 * rng.normal(size=(8, 16))[rng.integers(8, size=n)]).round().astype(np.int64) * int(scale)
    ids = rng.permutation(n)
    blocks = [(ids[a : a + 200], c[a : a + 200]) for a in range(0, n, 200)]
    a, b, s = topk.search(ids[:30], c[:30], iter(blocks), 7)
    want = set()
    for q in range(30):
        scores = [(-sum(int(x) * int(y) for x, y in zip(c[q], c[j])), int(ids[j])) for j in range(n) if j != q]
        want |= {(int(ids[q]), i, -t) for t, i in sorted(scores)[:7]}
    assert set(zip(a.tolist(), b.tolist(), s.tolist())) == want and len(a) == 30 * 7


def test_bounds_hold():
    rng = np.random.default_rng(4)
    c, q = rng.integers(-40, 40, (300, 12)), rng.integers(-40, 40, (20, 12))
    lists = topk.Lists(c, np.float64)
    exact = q @ c.T
    last = None
    for depth in (1, 30, 150, 299, 300):
        low, high = lists.bounds(np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float), depth)
        assert (low <= exact).all() and (exact <= high).all()
        assert last is None or ((high - low) <= last + 1e-9).all()
        last = high - low
    assert (last == 0).all()


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    want = sorted(con.execute(topk.SQL).fetchall())
    assert sorted(map(tuple, op7_top_k(spark, DATA).collect())) == want


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], KIND)).collect() == []
