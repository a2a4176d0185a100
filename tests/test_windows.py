"""Trailing and running totals: the fixed cases, in batch and as a stream, and random ones against plain windows."""

from __future__ import annotations

from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.operators import boards
from podium.operators.running import previous, running, trailing
from podium.params import MINUTE, Params
from podium.streaming import pipeline
from podium.streaming.window_total import window_totals

P = replace(Params(), window=5 * MINUTE, slice=11 * MINUTE)
X = P.window
BASE = 1_704_067_200_000
BIG = 2**52
#: user -> (gain, time) in order; expected (total, total before).
CASES = {
    "accumulation": ([(10, 0), (15, MINUTE)], [(10, 0), (25, 10)]),
    "retraction": ([(10, 0), (20, 2 * MINUTE), (30, 6 * MINUTE)], [(10, 0), (30, 10), (50, 30)]),
    "long pause": ([(10, 0), (20, MINUTE), (5, 30 * MINUTE)], [(10, 0), (30, 10), (5, 30)]),
    "first user": ([(10, 0), (20, MINUTE)], [(10, 0), (30, 10)]),
    "second user": ([(5, 0), (15, MINUTE)], [(5, 0), (20, 5)]),
    "same time": ([(10, 0), (15, 0), (5, 0)], [(30, 0)]),
    "zero": ([(0, 0)], [(0, 0)]),
    "negative": ([(10, 0), (-5, MINUTE)], [(10, 0), (5, 10)]),
    "large": ([(BIG, 0)], [(BIG, 0)]),
    "outside by 1 ms": ([(10, 0), (20, X + 1)], [(10, 0), (20, 10)]),
    "at the edge": ([(10, 0), (20, X)], [(10, 0), (30, 10)]),
    "values": ([(10, 0), (15, MINUTE), (5, 6 * MINUTE)], [(10, 0), (25, 10), (20, 25)]),
}


@pytest.fixture(scope="module")
def gains(spark):
    return spark.createDataFrame([(u, BASE + t, g) for u, (rows, _) in CASES.items() for g, t in rows], "uid string, t long, gain long")


def by_user(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["uid"], r["t"])):
        out.setdefault(r["uid"], []).append((r["total"], r["prev_total"]))
    return out


def test_batch(gains):
    peers = gains.groupBy("uid", "t").agg(F.sum("gain").alias("gain"))
    got = previous(trailing(peers, "uid", "t", P.slice, {"total": (F.col("gain"), X)}), "uid", "t", P.slice, "total", "prev_total", 0)
    assert by_user(got.collect()) == {u: want for u, (_, want) in CASES.items()}


def test_stream(spark, gains):
    source = pipeline.replay(gains, "cases", parts=2)
    got = pipeline.real(window_totals(pipeline.run_to_end(spark, lambda: pipeline.totals_stream(spark, source, P), "cases")))
    assert by_user(got.collect()) == {u: want for u, (_, want) in CASES.items()}


def test_late_rows(spark):
    """A row at or before the user's last result is late, even if the watermark would still let it in."""
    from podium.streaming.window_total import Trailing

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    class Handle:
        timers = set()

        def getValueState(self, *a):
            return State()

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

    class Expired:
        def __init__(self, t):
            self.t = t

        def getExpiryTimeInMs(self):
            return self.t

        getCurrentWatermarkInMs = getExpiryTimeInMs

    import pandas as pd

    p = Trailing([X])
    p.init(Handle())
    feed = lambda *rows: list(p.handleInputRows(("u",), iter([pd.DataFrame(rows, columns=["t", "gain"])]), None))
    assert feed((BASE, 10), (BASE + MINUTE, 20)) == []

    def fire(t):
        """The one timer that is set, when the watermark has come to ``t``."""
        (at,) = (timer for timer in Handle.timers if timer <= t)
        Handle.timers.remove(at)
        return [r.sums for f in p.handleExpiredTimer(("u",), Expired(t), Expired(at)) for r in f.itertuples()]

    assert fire(BASE) == [[10]] and fire(BASE + MINUTE) == [[30]]
    (late,) = feed((BASE + 30_000, 5))
    assert late["kind"].tolist() == ["late"] and p.state.get()[5] == 1
    assert fire(BASE + MINUTE + X + X // 2 + 1) == [] and p.state.get()[0] == [] and p.state.get()[4] == 30.0
    feed((BASE + 20 * MINUTE, 5), (BASE + 21 * MINUTE, 1), (BASE + 40 * MINUTE, 2))
    assert fire(BASE + 22 * MINUTE) == [[5], [6]] and fire(BASE + 41 * MINUTE) == [[2]]


def submissions(spark, rows):
    return spark.createDataFrame([(i, f"u{u}", BASE + t, g, 0, u % 2) for i, (u, t, g) in enumerate(rows)], "event_id long, uid string, t long, g long, level long, team int")


ROWS = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3000), st.integers(-3, 5)), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, span=st.sampled_from([1, 7, 100, 10_000]))
def test_slices_change_nothing(spark, rows, span):
    s = submissions(spark, rows)
    w = Window.partitionBy("uid").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = s.select("event_id", F.sum("g").over(w).alias("x"), F.max("g").over(w).alias("y")).collect()
    got = running(s, "uid", ["t", "event_id"], "t", span, {"x": F.col("g")}, {"y": F.col("g")}).select("event_id", "x", "y").collect()
    assert sorted(got) == sorted(want)
    peers = s.groupBy("uid", "t").agg(F.sum("g").alias("g"))
    w = Window.partitionBy("uid").orderBy("t")
    want = peers.withColumn("x", F.sum("g").over(w.rangeBetween(-50, 0))).withColumn("p", F.lag("x", 1, 0).over(w)).select("uid", "t", "x", "p").collect()
    got = previous(trailing(peers, "uid", "t", span, {"x": (F.col("g"), 50)}), "uid", "t", span, "x", "p", 0).select("uid", "t", "x", "p").collect()
    assert sorted(got) == sorted(want)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS)
def test_team_mvp_is_the_state_machine(spark, rows):
    s = submissions(spark, rows).withColumn("level", F.col("g"))
    p = replace(Params(), slice=500)
    total, team, mvp, want = {}, {}, {}, []
    for i, (u, t, g) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        k, gain = u % 2, max(g, 0)
        total[u] = total.get(u, 0) + gain
        team[k] = team.get(k, 0) + gain
        who, best = mvp.get(k, ("", 0))
        before = who
        if total[u] > best:
            mvp[k] = who, best = f"u{u}", total[u]
        want.append((i, who, best, team[k], round(best / team[k], 6) if team[k] else 0.0, before))
    got = boards.team_mvp_history(s, p).select("event_id", "mvp", "mvp_total", "team_total", "ratio", "prev_mvp").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    last = {r["team"]: r["mvp"] for r in boards.team_mvp(s, p).collect()}
    assert last == {k: v for k, (v, _) in mvp.items()} | {k: "" for k in team if k not in mvp}
