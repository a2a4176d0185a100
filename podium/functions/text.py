"""Keys and renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def board_key(name: str, *parts: Column) -> Column:
    """``name:part:part``."""
    return F.concat_ws(":", F.lit(name), *[p.cast("string") for p in parts])


#: How a score and a change of a board are written out.
SCORE_TEXT = "Score{id='%s', score=%.2f, lastUpdateTime=%d, previousScore=%.2f}"
CHANGE_TEXT = "%s %s"


def score_text(uid: Column, score: Column, t: Column, previous: Column) -> Column:
    return F.format_string(SCORE_TEXT, uid, score, t, F.coalesce(previous, F.lit(0.0)))


def change_text(kind: Column, score: Column) -> Column:
    return F.format_string(CHANGE_TEXT, kind, score)
