"""Window aggregates whose work is split by time, so that a key with very many rows isn't one task's.

A slice is the rows of one key in one span of time. Within slices, ordinary window functions do the work;
what a slice needs from earlier ones is a row for each slice (running aggregates) or the rows of the last
frame (trailing ones), which go to the next slice as well. Keys with more than MOST rows get slices of their own length, so
that however many rows a key has, a slice has some MOST of them on average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a key in one slice, on average; keys that get slices of their own length at most, the largest ones.
MOST, HOT = 1 << 20, 100_000


def sliced(df: DataFrame, key: str, time: str, span: int, least: int = 1, most: int | None = None) -> DataFrame:
    """``df`` with ``_span``, the length of its key's slices, and ``_slice``.

    Slices are ``span`` milliseconds long, for keys with more than ``most`` rows shorter in proportion, but ``least`` at
    least. Only the lengths of the HOT largest such keys are broadcast.
    """
    most = most or MOST
    per = df.groupBy(key).agg(F.count("*").alias("_n"), F.min(time).alias("_a"), F.max(time).alias("_z")).where(F.col("_n") > most)
    length = F.greatest(F.lit(least), F.floor((F.col("_z") - F.col("_a") + 1) / F.col("_n") * most))
    hot = per.orderBy(F.desc("_n"), key).limit(HOT).select(F.col(key).alias("_hot"), length.cast("long").alias("_own"))
    rows = df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    rows = rows.withColumn("_span", F.least(F.coalesce("_own", F.lit(span)), F.lit(span)))
    return rows.withColumn("_slice", F.floor(F.col(time) / F.col("_span"))).drop("_hot", "_own")


def running(df: DataFrame, key: str, order: list[str], time: str, span: int, sums: dict[str, Column], tops: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with running sums and running maxima of each ``key`` in the order of ``order``.

    ``order`` has to start with ``time``, epoch milliseconds. Two shuffles by (key, slice), one of which has a
    row for each slice only.
    """
    tops = tops or {}
    rows = sliced(df, key, time, span)
    own = {**{k: (F.sum, c) for k, c in sums.items()}, **{k: (F.max, c) for k, c in tops.items()}}
    per = rows.groupBy(key, "_slice").agg(*[f(c).alias(f"_{k}") for k, (f, c) in own.items()])
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(F.col(key).alias("_key"), F.col("_slice").alias("_at"), *[f(f"_{k}").over(before).alias(f"_{k}") for k, (f, _) in own.items()])
    here = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carried, (F.col(key) == F.col("_key")) & (F.col("_slice") == F.col("_at")), "left")
    out = [(F.coalesce(F.col(f"_{k}"), F.lit(0)) + f(c).over(here)) if f is F.sum else F.greatest(F.col(f"_{k}"), f(c).over(here)) for k, (f, c) in own.items()]
    return rows.select(*df.columns, *[c.alias(k) for k, c in zip(own, out)])


def trailing(df: DataFrame, key: str, time: str, span: int, frames: dict[str, tuple[Column, int]]) -> DataFrame:
    """``df`` with sums over RANGE frames of each ``key``: from ``time - width`` to ``time``, both included.

    ``frames``: name -> (column, width). ``span`` has to be as long as the longest frame; rows of a slice's last frame go
    to the next slice too, where they only count. One shuffle by (key, slice).
    """
    widest = max(w for _, w in frames.values())
    span = max(span, widest + 1)
    rows = sliced(df, key, time, span, widest + 1)
    late = F.pmod(F.col(time), F.col("_span")) >= F.col("_span") - widest
    own = F.col("_slice")
    rows = rows.withColumn("_in", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    here = Window.partitionBy(key, "_in").orderBy(time)
    got = rows.select("*", *[F.sum(c).over(here.rangeBetween(-w, 0)).alias(k) for k, (c, w) in frames.items()])
    return got.where(F.col("_in") == F.col("_slice")).drop("_in", "_slice", "_span")


def previous(df: DataFrame, key: str, time: str, span: int, value: str, name: str, default, order: list[str] | None = None) -> DataFrame:
    """``df`` with the ``value`` of the key's row before, ``default`` for its first; rows in ``order``, which starts with
    ``time``, or one row for each (key, time).

    Within a slice by LAG; a slice's first row takes the last value of the slices before.
    """
    order = order or [time]
    rows = sliced(df, key, time, span)
    last = rows.groupBy(key, "_slice").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    before = Window.partitionBy(key).orderBy("_slice")
    carried = last.select(F.col(key).alias("_key"), F.col("_slice").alias("_at"), F.lag("_last").over(before).alias("_came"))
    here = Window.partitionBy(key, "_slice").orderBy(*order)
    rows = rows.join(carried, (F.col(key) == F.col("_key")) & (F.col("_slice") == F.col("_at")), "left")
    came = F.coalesce(F.lag(F.struct(F.col(value).alias("v"))).over(here), F.col("_came"))
    return rows.select(*df.columns, F.when(came.isNull(), F.lit(default)).otherwise(came["v"]).alias(name))
