"""Periodic snapshots of the board as one relational plan.

With t0 and t1 the first and last time, snapshot i is taken at t0 + i*S. Stale users leave at t0 + 2C, t0 + 3C, ...:
the last such time before a snapshot gives the cutoff t0 + C*max(0, ceil(i*S/C) - 2). A total at t can so be part of
few snapshots only; it is exploded to these instead of joined with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.params import Params


def bounds(rows: DataFrame) -> DataFrame:
    """``t0, t1``: first and last time; one row. Best taken from what the totals are made of, which is cheaper
    to read again than totals are to compute again."""
    return rows.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))


def cutoff(i: Column, p: Params) -> Column:
    """Milliseconds after the first time."""
    return F.greatest(F.lit(0), F.ceil(i * p.snapshot / p.cleanup) - 2) * p.cleanup


def grid(span: DataFrame, p: Params) -> DataFrame:
    """``snapshot, taken, cutoff`` of :func:`bounds`: every snapshot there is, those without rows too."""
    i = F.col("snapshot")
    some = span.where(f"t1 - t0 >= {p.snapshot}")
    rows = some.select("t0", F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"(t1 - t0) div {p.snapshot}"))).alias("snapshot"))
    return rows.select("snapshot", (F.col("t0") + i * p.snapshot).alias("taken"), (F.col("t0") + cutoff(i, p)).alias("cutoff"))


def members(totals: DataFrame, p: Params, inclusive: bool = False, span: DataFrame | None = None) -> DataFrame:
    """``snapshot, taken, uid, total, t``: each user's last total in each snapshot.

    ``span``: :func:`bounds`, if known. A total counts if ``cutoff < t <= taken``; with ``inclusive``, the rule of the stream, if ``cutoff <= t < taken``.
    Partly aggregated before the shuffle by (snapshot, user).
    """
    spark = totals.sparkSession
    s, c = p.snapshot, p.cleanup
    rows = spark.sql(
        f"""SELECT uid, total, t, t - b0 AS age, b1 - b0 AS length, b0 FROM
        (SELECT *, (SELECT t0 FROM {{span}}) AS b0, (SELECT t1 FROM {{span}}) AS b1 FROM {{totals}})""",
        totals=totals,
        span=bounds(totals) if span is None else span,
    )
    first = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("age") / s))
    last = F.least(F.floor((F.col("age") + 2 * c) / s), F.floor(F.col("length") / s))
    rows = rows.where(last >= first).select("*", F.explode(F.sequence(first, last)).alias("snapshot"))
    i, age = F.col("snapshot"), F.col("age")
    inside = (cutoff(i, p) <= age) & (age < i * s) if inclusive else (cutoff(i, p) < age) & (age <= i * s)
    rows = rows.where(inside).withColumn("taken", F.col("b0") + i * s)
    return rows.groupBy("snapshot", "taken", "uid").agg(F.max_by("total", "t").alias("total"), F.max("t").alias("t"))


def top(totals: DataFrame, p: Params, inclusive: bool = False, span: DataFrame | None = None) -> DataFrame:
    """``snapshot, taken, rank, uid, total, t``: the ``top_n`` of each snapshot."""
    w = Window.partitionBy("snapshot").orderBy(F.desc("total"), "t", "uid")
    got = members(totals, p, inclusive, span).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.top_n)
    return got.select("snapshot", "taken", "rank", "uid", "total", "t")


def documents(ranked: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """``_id, users``: one document for each snapshot, users by rank; with ``every`` (a grid) the empty ones too."""
    user = F.struct(F.col("rank"), F.struct(F.col("uid").alias("userId"), F.col("total").cast("double").alias("score"), F.col("t").alias("lastUpdateTime")).alias("user"))
    docs = ranked.groupBy(F.col("taken").alias("_id")).agg(F.transform(F.array_sort(F.collect_list(user)), lambda x: x["user"]).alias("users"))
    if every is None:
        return docs
    kind = docs.schema["users"].dataType
    return every.select(F.col("taken").alias("_id")).join(docs, "_id", "left").select("_id", F.coalesce("users", F.array().cast(kind)).alias("users"))


def flat(docs: DataFrame) -> DataFrame:
    """``_id, rank, userId, score, lastUpdateTime`` of all users of all documents."""
    rows = docs.select("_id", F.posexplode("users").alias("pos", "user"))
    return rows.select("_id", (F.col("pos") + 1).alias("rank"), "user.*")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Documents of ``new`` replace those of ``stored`` with the same ``_id``."""
    return stored.join(new, "_id", "left_anti").unionByName(new)
