"""Rows that share an id but not a text: each component keeps a row."""

from __future__ import annotations

import pytest

from podium.llm import near_copies, simhash


@pytest.mark.parametrize("module", [simhash, near_copies])
def test_no_text_is_lost(spark, module):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a), (3, c), (4, b), (None, c)]
    got = module.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, a), (1, b), (3, c), (None, c)], key=str)
