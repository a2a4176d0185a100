"""Trailing sums per user on event time, with state: buffered peers, the last emitted result, the last time.

A user has one timer, for the next time that is to come out; when the watermark passes it, the results of all
times up to the watermark come out, each with the one before. A row is late, and dropped and counted, if
its time isn't after the last one that came out for its user.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A user's state in one value: buffered times with their sums and counts (those not after ``last`` are out already),
#: the last time and value that came out, late rows so far, and the one timer that is set (-1: none).
_STATE = T.StructType(
    [T.StructField(c, T.ArrayType(T.LongType())) for c in ("ts", "gains", "ns")]
    + [T.StructField("last", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("late", T.LongType()), T.StructField("timer", T.LongType())]
)

#: One row for each (user, time), and for each late row (kind ``late``, which has its time only).
RESULT = "kind string, uid string, t bigint, sums array<bigint>, counts array<bigint>, previous double, event_time timestamp"


class Trailing(StatefulProcessor):
    """Sums and counts over RANGE frames of several widths that end at each time, both ends included.

    ``value`` turns sums and counts into the number that the next result carries as ``previous``.
    """

    def __init__(self, widths: list[int], value: str = "sum"):
        self.widths, self.value = widths, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)

    def _load(self) -> tuple[dict[int, tuple[int, int]], int, float, int, int]:
        if not self.state.exists():
            return {}, -1, 0.0, 0, -1
        ts, gains, ns, last, value, late, timer = self.state.get()
        return {t: (g, n) for t, g, n in zip(ts, gains, ns)}, last, value, late, timer

    def _save(self, rows: dict[int, tuple[int, int]], last: int, value: float, late: int, timer: int) -> None:
        ts = sorted(rows)
        self.state.update(([int(t) for t in ts], [int(rows[t][0]) for t in ts], [int(rows[t][1]) for t in ts], int(last), float(value), int(late), int(timer)))

    def _set(self, timer: int, to: int) -> int:
        """One timer for each user: for the next time that is to come out, or for clearing up."""
        if timer != to:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(to)
        return to

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        have, last, value, late, timer = self._load()
        too_late = []
        for part in rows:
            for t, gain in zip(part["t"].tolist(), part["gain"].tolist()):
                if t <= last:
                    too_late.append(t)
                    continue
                g, n = have.get(t, (0, 0))
                have[t] = g + int(gain), n + 1
        waiting = min((t for t in have if t > last), default=-1)
        if waiting >= 0:
            timer = self._set(timer, waiting)
        self._save(have, last, value, late + len(too_late), timer)
        if too_late:
            yield _frame([("late", key[0], t, None, None, None) for t in too_late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Everything that the watermark has passed comes out at once, each time on its own."""
        have, last, value, late, _ = self._load()
        now = expiredTimerInfo.getExpiryTimeInMs()
        passed, longest = max(now, timerValues.getCurrentWatermarkInMs()), max(self.widths)
        ts = sorted(have)
        begins, sums, counts, out = [0] * len(self.widths), [0] * len(self.widths), [0] * len(self.widths), []
        for t in ts:
            if t > passed:
                break
            for k, w in enumerate(self.widths):
                sums[k] += have[t][0]
                counts[k] += have[t][1]
                while t - ts[begins[k]] > w:
                    sums[k] -= have[ts[begins[k]]][0]
                    counts[k] -= have[ts[begins[k]]][1]
                    begins[k] += 1
            if t <= last:
                continue
            out.append(("total", key[0], t, list(sums), list(counts), value))
            last = t
            if self.value == "sum":
                value = float(sums[0])
            else:
                long = sums[1] / counts[1]
                value = (sums[0] / counts[0]) / long if long else 0.0
        if not out and ts and passed > max(ts) + longest:  # a long pause: nothing counts any more
            have = {}
        have = {t: x for t, x in have.items() if t > last - longest - 1}
        waiting = min((t for t in have if t > last), default=-1)
        timer = -1
        if waiting >= 0:
            timer = self._set(-1, waiting)
        elif have and out:
            timer = self._set(-1, last + longest + longest // 2 + 1)
        self._save(have, last, value, late, timer)
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["kind", "uid", "t", "sums", "counts", "previous"])
    out["event_time"] = pd.to_datetime(out["t"], unit="ms")
    return out


def trailing_stream(gains: DataFrame, widths: list[int], delay: int, value: str = "sum") -> DataFrame:
    """``RESULT`` rows of a stream ``uid, t, gain``; ``delay`` milliseconds of disorder are waited for.

    Rows that come after the watermark are dropped by the engine, which counts them; widen the delay to see
    them as late rows here.
    """
    timed = gains.where("uid IS NOT NULL AND t IS NOT NULL").withColumn("event_time", F.timestamp_millis("t"))
    return (
        timed.withWatermark("event_time", f"{delay} milliseconds")
        .groupBy("uid")
        .transformWithStateInPandas(Trailing(widths, value), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")
    )


def window_totals(results: DataFrame) -> DataFrame:
    """``uid, t, total, prev_total``."""
    return results.where("kind = 'total'").select("uid", "t", F.col("sums")[0].alias("total"), F.col("previous").cast("long").alias("prev_total"))


def hot_streaks(results: DataFrame) -> DataFrame:
    """``uid, t, short_avg, long_avg, hotness, prev_hotness``, six decimals."""
    short, long = F.col("sums")[0] / F.col("counts")[0], F.col("sums")[1] / F.col("counts")[1]
    hot = F.when(long == 0, F.lit(0.0)).otherwise(short / long)
    return results.where("kind = 'total'").select(
        "uid", "t", F.round(short, 6).alias("short_avg"), F.round(long, 6).alias("long_avg"), F.round(hot, 6).alias("hotness"), F.round("previous", 6).alias("prev_hotness")
    )
