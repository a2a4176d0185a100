"""A block's steps hold a few times its bytes, not a hundred times."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from podium.llm import common, suffix_dedup


def _peak(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


def test_gather_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    flat, begin, sizes = rng.integers(0, 256, 5000, dtype=np.uint8), rng.integers(0, 4000, 300), rng.integers(0, 900, 300)
    want = b"".join(flat[b : b + n].tobytes() for b, n in zip(begin, sizes))
    for piece in (1, 700, 1 << 19):
        monkeypatch.setattr(common, "GATHERED", piece)
        got, to = common.gather(flat, begin, sizes)
        assert got.tobytes() == want and got.dtype == flat.dtype and to.tolist() == [0, *np.cumsum(sizes).tolist()]
        none, to = common.gather(flat, begin[:0], sizes[:0])
        assert not len(none) and to.tolist() == [0]
        assert not len(common.gather(flat[:0], np.zeros(3, np.int64), np.zeros(3, np.int64))[0])


@pytest.mark.parametrize("n", [*range(50, 60), 63, 64, 65, 113, 114, 115, 500])
def test_marks_in_pieces(monkeypatch, n):
    raw = np.random.default_rng(n).integers(97, 100, n, dtype=np.uint8)
    want = suffix_dedup.window_marks(raw)
    monkeypatch.setattr(suffix_dedup, "PIECE", 7)
    places = n - suffix_dedup.WINDOW + 1
    assert suffix_dedup.window_marks(raw)[:places].tolist() == want[:places].tolist()


def test_memory_of_a_block():
    raw = np.random.default_rng(3).integers(97, 123, 4 << 20, dtype=np.uint8)
    begin = np.arange(0, len(raw) - 100, 17)
    assert _peak(lambda: common.gather(raw, begin, np.full(len(begin), 66))) < 100  # 264 at once
    assert _peak(lambda: suffix_dedup.window_marks(raw)) < 100
