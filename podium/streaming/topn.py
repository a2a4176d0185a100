"""The Top-N board as a changelog, with eviction of stale users and periodic snapshots.

:class:`Board` is the rule, one event after the other, free of the engine. State is by user, so a user is on the
board once whatever the score before was. Deadlines that an event has reached are worked off in the order
of their times, however long the pause was. :class:`Crowd` gives the same for very many events, and :class:`TopN` runs it
in a stream under one constant key; :func:`board_batches` instead compares boards between micro-batches.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from podium.operators import changelog
from podium.params import Params

#: Events between two looks at who can be on the board meanwhile, and while it isn't full.
STRETCH, SHORT = 1 << 15, 1 << 6


def _by_name(uid: str | None) -> tuple[bool, str]:
    return (uid is not None, uid or "")


@dataclass
class Board:
    n: int
    cleanup: int
    snapshot: int
    users: dict[str, tuple[float, int, int]] = field(default_factory=dict)  # uid -> score, time, arrival
    next_cleanup: int = -1
    next_snapshot: int = -1
    seq: int = 0

    def __post_init__(self) -> None:
        self.order = sorted((-s, a, u) for u, (s, _, a) in self.users.items())
        self._arrivals = max((a for _, _, a in self.users.values()), default=0)

    def _drop(self, uid: str) -> int:
        """Takes a user off; where they were."""
        score, _, arrival = self.users.pop(uid)
        at = bisect_left(self.order, (-score, arrival, uid))
        del self.order[at]
        return at

    def _change(self, kind: str, uid: str, score: float, t: int) -> tuple:
        self.seq += 1
        return (kind, self.seq, uid, score, t)

    def _evict(self, uid: str) -> list[tuple]:
        score, t, _ = self.users[uid]
        if self._drop(uid) >= self.n:
            return []
        out = [self._change("DELETE", uid, score, t)]
        if len(self.order) >= self.n:
            up = self.order[self.n - 1][2]
            out.append(self._change("INSERT", up, *self.users[up][:2]))
        return out

    def top(self) -> list[tuple[str, float, int]]:
        return [(u, *self.users[u][:2]) for _, _, u in self.order[: self.n]]

    def _nobody(self) -> bool:
        return not self.users

    def _clean(self, limit: int) -> Iterator[tuple]:
        for uid in sorted((u for u, (_, at, _) in self.users.items() if at < limit), key=_by_name):
            yield from self._evict(uid)

    def _deadlines(self, t: int) -> Iterator[tuple]:
        if self.next_snapshot < 0:
            self.next_snapshot, self.next_cleanup = t + self.snapshot, t + 2 * self.cleanup
        while min(self.next_snapshot, self.next_cleanup) <= t:
            if self.next_cleanup < self.next_snapshot:
                limit = self.next_cleanup - self.cleanup
                yield from self._clean(limit)
                self.next_cleanup += self.cleanup
            else:
                yield ("SNAPSHOT", self.next_snapshot, self.top())
                self.next_snapshot += self.snapshot
            if self._nobody():  # nothing can happen up to t: only the clocks move
                while self.next_cleanup <= t and self.next_cleanup < self.next_snapshot:
                    self.next_cleanup += self.cleanup

    def add(self, uid: str, score: float, t: int) -> Iterator[tuple]:
        """Changes (kind, seq, uid, score, t) and snapshots (SNAPSHOT, time, rows) that an event leads to."""
        yield from self._deadlines(t)
        full = len(self.order) >= self.n
        last = self.order[self.n - 1][2] if full else None
        promoted = self.order[self.n][2] if len(self.order) > self.n else None
        old = self.users.get(uid)
        was = self._drop(uid) if old else None
        held = was is not None and was < self.n
        self.users[uid] = (score, t, self.seq_arrival())
        entry = (-score, self.users[uid][2], uid)
        insort(self.order, entry)
        now = bisect_left(self.order, entry)
        if now < self.n:
            if not held and full:
                yield self._change("DELETE", last, *self.users[last][:2])
            yield self._change("INSERT", uid, score, t)
        elif held:
            yield self._change("DELETE", uid, *old[:2])
            if promoted is not None:
                yield self._change("INSERT", promoted, *self.users[promoted][:2])

    def seq_arrival(self) -> int:
        self._arrivals += 1
        return self._arrivals


class Crowd(Board):
    """A board with its users as arrays: what :class:`Board` gives for the same events, in the same order.

    In a stretch of events without a deadline, n users at least stay at or above the n-th highest of the users' lowest scores.
    Who never reaches that isn't on the board, nor next to it, so only the others and their events go through a Board.
    """

    def __init__(self, board: Board, uids: list[str | None]):
        """``uids``: the board's users and those of the events to come, by name; events name them by their places."""
        self.n, self.cleanup, self.snapshot = board.n, board.cleanup, board.snapshot
        self.next_cleanup, self.next_snapshot, self.seq, self._arrivals = board.next_cleanup, board.next_snapshot, board.seq, board._arrivals
        self.uids, n = uids, len(uids)
        self.on, self.score, self.t, self.arrival = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = {u: i for i, u in enumerate(uids)}
        for uid, row in board.users.items():
            i = place[uid]
            self.on[i], (self.score[i], self.t[i], self.arrival[i]) = True, row

    def row(self, i: int) -> tuple[float, int, int]:
        return float(self.score[i]), int(self.t[i]), int(self.arrival[i])

    def _nobody(self) -> bool:
        return not self.on.any()

    def _first(self, of: np.ndarray) -> np.ndarray:
        """The first n of some users, in order."""
        if len(of) > self.n:
            of = of[self.score[of] >= np.partition(self.score[of], len(of) - self.n)[len(of) - self.n]]
        return of[np.lexsort((self.arrival[of], -self.score[of]))][: self.n]

    def _board(self, of: np.ndarray) -> Board:
        users = {self.uids[i]: self.row(i) for i in of.tolist()}
        return Board(self.n, self.cleanup, self.snapshot, users, self.next_cleanup, self.next_snapshot, self.seq)

    def top(self) -> list[tuple[str, float, int]]:
        return [(self.uids[i], *self.row(i)[:2]) for i in self._first(np.flatnonzero(self.on)).tolist()]

    def _clean(self, limit: int) -> Iterator[tuple]:
        gone = self.on & (self.t < limit)
        stay = self._first(np.flatnonzero(self.on & ~gone))
        seen = gone & (self.score >= self.score[stay[-1]]) if len(stay) == self.n else gone  # the others leave from below the board
        board = self._board(np.append(stay, np.flatnonzero(seen)))
        yield from board._clean(limit)
        self.seq = board.seq
        self.on &= ~gone

    def run(self, whose: np.ndarray, score: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, tuple]]:
        """What :meth:`add` gives for each of the events, which are in the order of (time, user), with the event's time."""
        at = 0
        while at < len(t):
            now = int(t[at])
            for x in self._deadlines(now):
                yield now, x
            most = STRETCH if np.count_nonzero(self.on) >= self.n else SHORT
            to = min(at + most, int(np.searchsorted(t, min(self.next_snapshot, self.next_cleanup))))
            yield from self._stretch(whose[at:to], score[at:to], t[at:to])
            at = to

    def _stretch(self, whose: np.ndarray, score: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, tuple]]:
        low, high = self.score.copy(), np.where(self.on, self.score, -np.inf)
        np.minimum.at(low, whose, score)
        np.maximum.at(high, whose, score)
        low = low[self.on]
        may = high >= (np.partition(low, len(low) - self.n)[len(low) - self.n] if len(low) >= self.n else -np.inf)
        board = self._board(np.flatnonzero(may & self.on))
        for k in np.flatnonzero(may[whose]).tolist():
            now = int(t[k])
            for x in board.add(self.uids[whose[k]], float(score[k]), now):
                yield now, x
        self.seq = board.seq
        self.on[whose] = True
        self.score[whose], self.t[whose] = score, t  # of a user's events the last one remains
        self.arrival[whose] = self._arrivals + 1 + np.arange(len(t))
        self._arrivals += len(t)


_USER = T.StructType([T.StructField("uid", T.StringType())])
_ROW = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("t", T.LongType()), T.StructField("arrival", T.LongType())])
_CLOCK = T.StructType([T.StructField(c, T.LongType()) for c in ("next_cleanup", "next_snapshot", "seq")])

#: kind INSERT, DELETE (a change; ``taken`` the time of the event that led to it) or SNAPSHOT (one row for each user of it,
#: ``seq`` the rank; rank 0: none).
RESULT = "kind string, seq bigint, taken bigint, uid string, score double, t bigint"


def _events(part: pd.DataFrame, number: dict[str | None, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(user, score, time) of each row; users by their numbers, new ones get the next."""
    own, uids = pd.factorize(part["uid"], use_na_sentinel=False)
    of = np.array([number.setdefault(None if pd.isna(u) else u, len(number)) for u in uids], np.int64)
    return of[own], part["score"].to_numpy(np.float64), part["t"].to_numpy(np.int64)


class TopN(StatefulProcessor):
    """:class:`Board` over a stream; rows of a micro-batch are applied in the order of (time, user)."""

    def __init__(self, p: Params):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.users = handle.getMapState("users", _USER, _ROW)
        self.clock = handle.getValueState("clock", _CLOCK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: tuple(v) for k, v in self.users.iterator()}
        clock = self.clock.get() if self.clock.exists() else (-1, -1, 0)
        board = Board(self.p.top_n, self.p.cleanup, self.p.snapshot, before, *clock)
        number = {u: i for i, u in enumerate(before)}
        parts = [_events(part, number) for part in rows]
        uids = sorted(number, key=_by_name)
        place = np.empty(len(uids), np.int64)
        place[[number[u] for u in uids]] = np.arange(len(uids))
        whose, score, t = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((score, place[whose], t))
        crowd = Crowd(board, uids)
        out = []
        for now, x in crowd.run(place[whose][order], score[order], t[order]):  # a change's ``taken`` is the time of the event that led to it
            if x[0] == "SNAPSHOT":
                out += [("SNAPSHOT", k + 1, x[1], *u) for k, u in enumerate(x[2])] or [("SNAPSHOT", 0, x[1], None, None, None)]
            else:
                out.append((x[0], x[1], now, *x[2:]))
        for i, uid in enumerate(uids):
            if not crowd.on[i]:
                if uid in before:
                    self.users.removeKey((uid,))
            elif before.get(uid) != crowd.row(i):
                self.users.updateValue((uid,), crowd.row(i))
        self.clock.update((crowd.next_cleanup, crowd.next_snapshot, crowd.seq))
        frame = pd.DataFrame(out, columns=["kind", "seq", "taken", "uid", "score", "t"])
        yield frame.astype({"seq": "Int64", "taken": "Int64", "t": "Int64"})

    def close(self) -> None:
        pass


def topn_stream(scores: DataFrame, p: Params) -> DataFrame:
    """``RESULT`` rows of a stream ``uid, score, t, event_time`` that has a watermark. One key: one task."""
    keyed = scores.withColumn("board", F.lit(0))
    return keyed.groupBy("board").transformWithStateInPandas(TopN(p), outputStructType=RESULT, outputMode="Append", timeMode="None")


def board_after(latest: DataFrame, n: int) -> DataFrame:
    """``id, score, lastUpdateTime`` of the Top-N of users' latest scores (uid, score, t); distributed up to the last N of each task."""
    best = latest.orderBy(F.desc("score"), "t", "uid").limit(n)
    return best.select(F.col("uid").alias("id"), "score", F.col("t").alias("lastUpdateTime"))


def board_batches(before: DataFrame, after: DataFrame, n: int, seq: int = 0) -> DataFrame:
    """The numbered changelog between two micro-batches' boards: shorter than one change after the other, to the same board."""
    return changelog.numbered(changelog.difference(board_after(before, n), board_after(after, n)), seq)
