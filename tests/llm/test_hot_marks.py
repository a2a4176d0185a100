"""Repeated passages under marks that very many texts share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.llm import suffix_dedup

from .test_duplicates import as_digests

PHRASE = "all rights reserved by the author of this page"


def phrase_rows(n):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    prose = lambda k: " ".join(words[i] for i in rng.integers(400, size=k))
    rows = [(i, f"{prose(6)} {PHRASE} {prose(6)}") for i in range(n)]
    rows += [(n + k, rows[3 * k][1][5:90] + " tail") for k in range(20)]  # repeats across the phrase
    return rows + [(1000, rows[0][1] + " " + rows[1][1]), (1000, rows[2][1]), (None, rows[0][1])]


@pytest.mark.parametrize("hot", [1, 7, 40, 1 << 15])
def test_a_phrase_in_every_text(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 2000)
    rows = phrase_rows(120)
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(as_digests(rows), key=str)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.text(alphabet="ab", min_size=40, max_size=130)), min_size=1, max_size=25), st.sampled_from([1, 3, 10]))
def test_few_letters(spark, rows, hot):
    kept = suffix_dedup.HOT, suffix_dedup.BLOCK
    suffix_dedup.HOT, suffix_dedup.BLOCK = hot, 200
    try:
        got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    finally:
        suffix_dedup.HOT, suffix_dedup.BLOCK = kept
    assert sorted(map(tuple, got)) == sorted(as_digests(rows))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(1, 9)), max_size=40), st.integers(1, 7), st.integers(1, 12))
def test_no_more_rows_of_a_mark_are_held_than_make_it_hot(rows, batch, hot):
    """Marks in order, cut into batches anywhere: what several blocks have comes out, hot ones as hot."""
    rows = sorted((m, k, n) for k, (m, n) in enumerate(rows))
    mark = np.array([r[0] for r in rows], np.int64)
    own = np.array([(r[1] << suffix_dedup._N) + r[2] for r in rows], np.int64)
    parts = (pa.RecordBatch.from_arrays([pa.array(mark[a : a + batch]), pa.array(own[a : a + batch])], names=["mark", "own"]) for a in range(0, len(rows), batch))
    got = [r for b in suffix_dedup._meet_marks(hot)(parts) for r in zip(*(c.to_pylist() for c in b.columns))]
    total, times = {}, {}
    for m, _, n in rows:
        total[m], times[m] = total.get(m, 0) + n, times.get(m, 0) + 1
    assert sorted(got) == sorted((k, m, total[m] > hot) for m, k, _ in rows if times[m] > 1)


def test_rows_grow_with_texts_only(spark, monkeypatch):
    """Rows that travel are bounded by the texts' bytes, however many blocks there are."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2000)
    rows = phrase_rows(100)
    blocks, total = suffix_dedup._blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    size = sum(len(t) for _, t in rows)
    assert blocks.count() >= 8 and total == size
    assert blocks.select("block", "data").mapInArrow(suffix_dedup._send_marks, "mark bigint, own bigint").count() < size / 8
