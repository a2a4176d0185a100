"""Bounds of the top-k search under scores far below zero."""

from __future__ import annotations

import numpy as np
import pytest

from podium.llm import topk


def test_own_row_takes_no_place():
    c = np.append(10**6, -(10**6) - 1000 * np.arange(99))[:, None]
    ids = np.arange(100)
    _, found, score = topk.search(ids[:1], c[:1], iter([(ids, c)]), 20)
    assert sorted(found.tolist()) == list(range(1, 21))
    assert sorted(score.tolist()) == sorted((10**6 * c[1:21, 0]).tolist())


def brute(ids, c, q, k):
    out = []
    for i in q:
        best = sorted((-sum(int(a) * int(b) for a, b in zip(c[i], c[j])), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[i])[:k]
        out += [(int(ids[i]), j, -s) for s, j in best]
    return sorted(out)


@pytest.mark.parametrize("size", [10, 10**4, 10**6, 3 * 10**8])
@pytest.mark.parametrize("blocks", [1, 2, 5])
def test_scores_far_below_zero(size, blocks):
    """One positive query, negative vectors; the query's id many times over."""
    rng = np.random.default_rng(size)
    c = np.concatenate([np.full((1, 3), size), -rng.integers(size // 2, size, (99, 3)), np.full((21, 3), size)])
    ids = np.append(np.arange(100), np.zeros(21, np.int64))
    parts = [(ids[a], c[a]) for a in np.array_split(np.arange(len(ids)), blocks)]
    a, b, s = topk.search(ids[:1], c[:1], iter(parts), 20)
    assert sorted(zip(a.tolist(), b.tolist(), s.tolist())) == brute(ids, c, [0], 20)


def test_reading_stops():
    """Clustered vectors: most of the lists stay unread, and what is read is counted."""
    rng = np.random.default_rng(3)
    c = (100 * rng.normal(size=(40, 16))[rng.integers(40, size=4000)] + rng.normal(size=(4000, 16))).round().astype(np.int64)
    ids, read = np.arange(4000), []
    parts = [(ids[a], c[a]) for a in np.array_split(ids, 4)]
    a, b, s = topk.search(ids[:50], c[:50], iter(parts), 10, read=read)
    assert sorted(zip(a.tolist(), b.tolist(), s.tolist())) == brute(ids, c, range(50), 10)
    assert len(read) == 4 and all(0 < x <= y for x, y in read) and read[-1][0] < 0.8 * read[-1][1]


def test_floor_loses_no_tie():
    c = np.array([[1], [5], [5], [5], [4]])
    ids = np.array([0, 3, 2, 1, 4])
    _, b, s = topk.search(ids[:1], c[:1], iter([(ids, c)]), 2, np.array([5]))
    assert sorted(zip(b.tolist(), s.tolist())) == [(1, 5), (2, 5)]


KIND = "vec_id long, embedding array<float>"


def test_lots_and_rounds(spark, monkeypatch):
    """Many lots, rounds and blocks give what one of each gives; of a repeated id the smallest vector asks."""
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 6)))]
    rows += [(20, [1.0, 2.0]), (20, [-9.0, 1.0]), (40, rows[40][1]), (7, rows[7][1]), (7, rows[8][1])]
    df = spark.createDataFrame(rows, KIND).repartition(6)
    whole = np.zeros((len(rows), 6), np.int64)
    for i, (_, v) in enumerate(rows):
        whole[i, : len(v)] = np.floor(64 * np.array(v, np.float32).astype(float))
    ids = np.array([r[0] for r in rows])
    asks = [min((i for i in range(len(rows)) if ids[i] == n), key=lambda i: rows[i][1]) for n in range(0, 400, 20)]
    want = brute(ids, whole, asks, 20)
    for lot, first, growth in [(1 << 24, 4, 16), (6 * 8 * 5, 2, 2), (6 * 8 * 100, 1, 3)]:
        got = topk.top_k(df, lot=lot, first=first, growth=growth).collect()
        assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == want
        assert sorted((r["query_id"], r["rank"]) for r in got) == [(n, k) for n in range(0, 400, 20) for k in range(1, 21)]


def test_rounds_cover_all_blocks():
    for n in (0, 1, 3, 8, 9, 100, 10**6):
        parts = topk.rounds(n, 4, 16)
        assert parts[0][0] == 0.0 and parts[-1][1] == 1.0 and all(a[1] == b[0] and a[0] < a[1] for a, b in zip(parts, parts[1:]))
