"""Near copies by Jaccard similarity, against a comparison of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from podium.llm import near_copies

from .conftest import DATA, key


def jaccard_components(rows, width=5):
    """(id, smallest id of its component) by comparing the shingle sets of all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} or ({b" ".join(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return [(doc, low.get(find(i))) for i, (doc, _) in enumerate(rows)]


def families():
    """Texts with up to three of their words changed each, several families, passages in common."""
    rng = random.Random(3)
    out = []
    common = [f"c{i}" for i in range(12)]
    for f in range(8):
        base = [f"w{f}x{rng.randrange(40)}" for _ in range(rng.randrange(30, 120))] + common
        for _ in range(30):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(t))
    rng.shuffle(out)
    return list(enumerate(out))


def kept(df):
    return sorted(df.select("doc_id").collect(), key=key)


def test_pipeline_stage_removes_near_copies(spark, documents):
    """Pairs such as 145/6 (similarity 0.83, 7 bits apart) and 177/1 (0.83, 11 bits)."""
    want = {low for _, low in jaccard_components([(r["doc_id"], r["text"]) for r in documents.collect()])}
    got = corpus_pipeline.near_duplicates(spark, documents, DATA)
    assert got.columns == documents.columns
    assert [r["doc_id"] for r in kept(got)] == [i for (i,) in sorted(((w,) for w in want), key=key)]
    assert not {145, 177} & want


@pytest.mark.parametrize("meeting", [4096, 7])
def test_all_pairs(spark, monkeypatch, meeting):
    monkeypatch.setattr(near_copies, "MEETING", meeting)
    rows = families()
    got = near_copies.rooted(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    low = {}
    for r in got.collect():
        low.setdefault(r["root"], []).append(r["doc_id"])
    want = {}
    for doc, first in jaccard_components(rows):
        want.setdefault(first, []).append(doc)
    assert sorted(map(sorted, low.values())) == sorted(map(sorted, want.values()))
    assert 8 < len(want) < len(rows)


def test_messy(spark, messy, messy_rows, empty):
    got = near_copies.deduplicate(messy)
    assert got.columns == messy.columns
    want = {low for _, low in jaccard_components([r[:2] for r in messy_rows]) if low is not None}
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2
    assert near_copies.deduplicate(empty).collect() == []


def test_bounds():
    """The parities differ at most where the sets do, and prefixes of similar sets meet."""
    rng = np.random.default_rng(2)
    often = np.sort(rng.integers(0, 300, 20, dtype=np.uint64))
    often = np.unique(often)
    for _ in range(300):
        a = np.unique(rng.integers(0, 300, rng.integers(5, 200), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: int(len(a) * 0.9)], rng.integers(0, 300, 3, dtype=np.uint64)]))
        x, y = (np.frombuffer(near_copies.parities(s), np.uint64) for s in (a, b))
        both = len(np.intersect1d(a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * both
        if 100 * both >= 80 * (len(a) + len(b) - both):
            p, q = (near_copies._prefix(s, often, np.arange(1, len(often) + 1), 80) for s in (a, b))
            assert len(np.intersect1d(p, q))
