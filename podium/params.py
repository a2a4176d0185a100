"""Tunable sizes of the boards, in milliseconds where they are times."""

from __future__ import annotations

from dataclasses import dataclass, replace

MINUTE = 60_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


@dataclass(frozen=True)
class Params:
    """Defaults suit users who act every few seconds."""

    window: int = MINUTE  # trailing total
    short: int = 10_000  # hot streak, short and long average
    long: int = 60_000
    cleanup: int = 5 * MINUTE  # stale users leave
    snapshot: int = 7 * MINUTE
    top_n: int = 10
    watermark: int = 10_000
    slice: int = 30 * DAY  # a key's rows are worked on in slices of this time


#: For tables whose users act every few hours.
SPARSE = replace(Params(), window=24 * HOUR, short=4 * HOUR, long=24 * HOUR, cleanup=5 * HOUR, snapshot=7 * HOUR)
