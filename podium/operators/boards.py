"""Gains, totals, rankings and team boards from submissions.

A submission is a row ``event_id, uid, t, g, level, team``: ``t`` epoch milliseconds, ``g`` the level minus the
previous level, which may be negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions import day_of, week_number, week_start
from podium.operators.running import previous, running, trailing
from podium.params import Params


def gain(level: Column, before: Column) -> Column:
    """Levels gained, never negative."""
    return F.greatest(level - before, F.lit(0))


def gain_when(level: Column, before: Column) -> Column:
    """The same with a conditional; null where a level is null."""
    d = level - before
    return F.when(d > 0, d).when(d.isNotNull(), F.lit(0))


def clipped(delta: Column) -> Column:
    """The same where the difference is known; levels, which need a running sum, are then not computed."""
    return F.greatest(delta, F.lit(0))


def level_gains(submissions: DataFrame) -> DataFrame:
    """``event_id, uid, t, delta, gain``."""
    return submissions.select("event_id", "uid", "t", F.col("g").alias("delta"), clipped(F.col("g")).alias("gain"))


def peers(submissions: DataFrame) -> DataFrame:
    """``uid, t, gain, n``: a user's submissions of one millisecond are one row. Aggregated before the shuffle."""
    return level_gains(submissions).groupBy("uid", "t").agg(F.sum("gain").alias("gain"), F.count("*").alias("n"))


def window_total(submissions: DataFrame, p: Params) -> DataFrame:
    """``uid, t, total, prev_total``: gains of the trailing window, both ends included, and the total before."""
    got = trailing(peers(submissions), "uid", "t", p.slice, {"total": (F.col("gain"), p.window)})
    return previous(got.select("uid", "t", "total"), "uid", "t", p.slice, "total", "prev_total", 0)


def window_total_raw(submissions: DataFrame, p: Params) -> DataFrame:
    """``event_id, uid, t, total, prev_total``: the same for each submission, peers not joined; the one before by (t, event_id)."""
    rows = level_gains(submissions)
    got = trailing(rows, "uid", "t", p.slice, {"total": (F.col("gain"), p.window)})
    return previous(got.select("event_id", "uid", "t", "total"), "uid", "t", p.slice, "total", "prev_total", 0, ["t", "event_id"])


def latest(totals: DataFrame, score: str, by: str = "uid", time: str = "t") -> DataFrame:
    """The last row of each user; aggregated before the shuffle."""
    return totals.groupBy(by).agg(F.max(time).alias(time), F.max_by(score, time).alias(score))


def top_n(rows: DataFrame, score: str, n: int, time: str = "t", member: str = "uid") -> DataFrame:
    """The ``n`` best rows with their rank: score descending, then time, then member. Never sorts more than each
    task's ``n`` best rows in one place."""
    order = [F.desc(score), F.asc(time), F.asc(member)]
    best = rows.orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def alltime_level(submissions: DataFrame) -> DataFrame:
    """``uid, level, t``: the last written level, not the highest."""
    last = F.struct("t", "event_id")
    return submissions.groupBy("uid").agg(F.max_by("level", last).alias("level"), F.max("t").alias("t"))


def _weeks(submissions: DataFrame) -> DataFrame:
    day = day_of(F.col("t"))
    return submissions.select("*", F.year(day).alias("year"), week_number(day).alias("week"), week_start(day).alias("week_start"))


def weekly_levels_gained(submissions: DataFrame) -> DataFrame:
    """``year, week, uid, levels``: sums of positive deltas. The year is the calendar's, so a year's last days
    fall into its week 1."""
    return _weeks(submissions.where("g > 0")).groupBy("year", "week", "uid").agg(F.sum("g").alias("levels"))


def weekly_last_level(submissions: DataFrame) -> DataFrame:
    """``year, week, uid, last_level, max_level``: the last level written in the week, and the highest."""
    last = F.struct("t", "event_id")
    return _weeks(submissions).groupBy("year", "week", "uid").agg(F.max_by("level", last).alias("last_level"), F.max("level").alias("max_level"))


def user_alltime_total(submissions: DataFrame, p: Params) -> DataFrame:
    """``event_id, uid, team, t, gain, total``: running total of each user, one row for each submission."""
    rows = submissions.select("event_id", "uid", "team", "t", clipped(F.col("g")).alias("gain"))
    return running(rows, "uid", ["t", "event_id"], "t", p.slice, {"total": F.col("gain")})


def team_mvp_history(submissions: DataFrame, p: Params) -> DataFrame:
    """``event_id, team, t, mvp, mvp_total, team_total, ratio, prev_mvp`` after each submission.

    A user takes over with a strictly larger total only; nobody holds a team whose totals are all zero.
    """
    totals = user_alltime_total(submissions, p)
    top = F.struct(F.col("total"), (-F.col("t")).alias("t"), (-F.col("event_id")).alias("event_id"), F.col("uid"))
    rows = running(totals, "team", ["t", "event_id"], "t", p.slice, {"team_total": F.col("gain")}, {"best": top})
    held = rows.select(
        "event_id", "team", "t", F.when(F.col("best.total") > 0, F.col("best.uid")).otherwise("").alias("mvp"), F.col("best.total").alias("mvp_total"), "team_total",
        ratio(F.col("best.total"), F.col("team_total")).alias("ratio"),
    )
    return previous(held, "team", "t", p.slice, "mvp", "prev_mvp", "", ["t", "event_id"])


def team_mvp(submissions: DataFrame, p: Params) -> DataFrame:
    """``team, mvp, mvp_total, team_total, ratio, t``: each team's state after its last submission.

    Needs no order of all rows: the holder is the first to reach the largest total of the team.
    """
    totals = user_alltime_total(submissions, p)
    top = F.struct(F.col("total"), (-F.col("t")).alias("t"), (-F.col("event_id")).alias("event_id"), F.col("uid"))
    got = totals.groupBy("team").agg(F.max(top).alias("best"), F.sum("gain").alias("team_total"), F.max("t").alias("t"))
    return got.select(
        "team", F.when(F.col("best.total") > 0, F.col("best.uid")).otherwise("").alias("mvp"), F.col("best.total").alias("mvp_total"), "team_total",
        ratio(F.col("best.total"), F.col("team_total")).alias("ratio"), "t",
    )


def ratio(part: Column, whole: Column) -> Column:
    """0 where the whole is 0; six decimals."""
    return F.round(F.when(whole == 0, F.lit(0.0)).otherwise(part / whole), 6)


def hot_streak(submissions: DataFrame, p: Params) -> DataFrame:
    """``uid, t, short_avg, long_avg, hotness, prev_hotness``: average gain of a submission over the short and the
    long window, and their ratio, 0 where the long average is 0. Both windows share one shuffle and sort."""
    frames = {f"_{k}_{c}": (F.col(c), w) for k, w in (("s", p.short), ("l", p.long)) for c in ("gain", "n")}
    got = trailing(peers(submissions), "uid", "t", max(p.slice, p.long + 1), frames)
    short, long = F.col("_s_gain") / F.col("_s_n"), F.col("_l_gain") / F.col("_l_n")
    got = got.select("uid", "t", F.round(short, 6).alias("short_avg"), F.round(long, 6).alias("long_avg"), ratio(short, long).alias("hotness"))
    return previous(got, "uid", "t", max(p.slice, p.long + 1), "hotness", "prev_hotness", 0.0)


def enrich(board: DataFrame, profiles: DataFrame) -> DataFrame:
    """``board`` with what ``profiles`` (uid, ...) knows of its members; those without a profile stay."""
    return board.join(profiles, "uid", "left")


def latest_batch(rows: DataFrame, batch: str) -> DataFrame:
    """The rows of the largest ``batch``, as by an uncorrelated scalar subquery."""
    return rows.sparkSession.sql(f"SELECT * FROM {{rows}} WHERE {batch} = (SELECT max({batch}) FROM {{rows}})", rows=rows)


def field_sums(rows: DataFrame, member: str, fields: list[str]) -> DataFrame:
    """Sum of each field for each member, the largest first field on top: what a dashboard's reduce step shows."""
    return rows.groupBy(member).agg(*[F.sum(f).alias(f) for f in fields]).orderBy(F.desc(fields[0]), member)
