"""Top-N boards of very many users and events."""

from __future__ import annotations

import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.params import MINUTE
from podium.streaming import topn
from podium.streaming.topn import Board, Crowd


def _replayed(crowd, uids, events):
    place = {u: i for i, u in enumerate(uids)}
    whose, score, t = [place[u] for _, u, _ in events], [float(s) for _, _, s in events], [t for t, _, _ in events]
    return list(crowd.run(np.array(whose), np.array(score), np.array(t)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 9), st.integers(0, 5)), min_size=1, max_size=150), st.integers(1, 4), st.integers(1, 149))
def test_crowd_is_the_board(events, n, cut):
    """Two batches through arrays and through single events: the same changes, snapshots and state."""
    events, uids = sorted((t, f"u{u}", s) for t, u, s in events), [f"u{u}" for u in range(10)]
    one, many = Board(n, 30, 50), Board(n, 30, 50)
    kept, topn.STRETCH, topn.SHORT = (topn.STRETCH, topn.SHORT), 20, 3
    try:
        for part in (events[:cut], events[cut:]):
            crowd = Crowd(many, uids)
            assert _replayed(crowd, uids, part) == [(t, x) for t, u, s in part for x in one.add(u, float(s), t)]
            users = {u: crowd.row(i) for i, u in enumerate(uids) if crowd.on[i]}
            many = Board(n, 30, 50, users, crowd.next_cleanup, crowd.next_snapshot, crowd.seq)
            assert [u for *_, u in many.order] == [u for *_, u in one.order]
    finally:
        topn.STRETCH, topn.SHORT = kept


def test_time_of_an_event():
    """An event's time doesn't grow with the users: looking at all of them took 30,000 ** 2 / 2 steps here."""
    b, began = Board(10, 5 * MINUTE, 7 * MINUTE), time.process_time()
    for i in range(30_000):
        list(b.add(f"u{i}", float(i * 7919 % 30_011), i))
    assert len(b.users) == 30_000 and time.process_time() - began < 5


def test_time_of_many_events():
    rng, n = np.random.default_rng(1), 200_000
    uids = [f"u{i:05d}" for i in range(50_000)]
    t, whose, score = np.sort(rng.integers(0, 100 * MINUTE, n)), rng.integers(0, len(uids), n), rng.integers(0, 10**6, n).astype(float)
    began = time.process_time()
    got = list(Crowd(Board(10, 5 * MINUTE, 7 * MINUTE), uids).run(whose, score, t))
    assert sum(x[0] == "SNAPSHOT" for _, x in got) == (int(t[-1]) - int(t[0])) // (7 * MINUTE)
    assert time.process_time() - began < 10
