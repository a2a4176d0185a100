"""Comparison of two sets of snapshot documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal(users: Column) -> Column:
    """Users as a sorted multiset: ids as text, numbers cut to whole ones, missing ones 0."""
    one = lambda u: F.struct(u["userId"].cast("string").alias("userId"), F.coalesce(u["score"].cast("long"), F.lit(0)).alias("score"), F.coalesce(u["lastUpdateTime"].cast("long"), F.lit(0)).alias("lastUpdateTime"))
    return F.array_sort(F.transform(F.coalesce(users, F.array()), one))


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """``_id, outcome``: equal, different or missing, for each document of ``a``; one-directional."""
    x = a.select("_id", normal(F.col("users")).alias("_a"))
    y = b.select("_id", normal(F.col("users")).alias("_b"), F.lit(True).alias("_there"))
    got = x.join(y, "_id", "left")
    return got.select("_id", F.when(F.col("_there").isNull(), "missing").when(F.col("_a") == F.col("_b"), "equal").otherwise("different").alias("outcome"))


def missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of ``a`` that ``b`` lacks."""
    return a.select("_id").join(b.select("_id"), "_id", "left_anti")


def summary(a: DataFrame, b: DataFrame, examples: int = 10) -> DataFrame:
    """One row ``total, found, equal, different, missing, found_pct, equal_pct, examples``; percentages of ``a``'s ids,
    0 if there are none; the first ``examples`` different ids."""
    rows = align(a, b)
    count = lambda kind: F.count_if(F.col("outcome") == kind)
    got = rows.agg(F.count("*").alias("total"), count("missing").alias("missing"), count("equal").alias("equal"), count("different").alias("different"))
    some = rows.where("outcome = 'different'").orderBy("_id").limit(examples).agg(F.array_sort(F.collect_list("_id")).alias("examples"))
    pct = lambda c: F.round(F.when(F.col("total") == 0, F.lit(0.0)).otherwise(100.0 * c / F.col("total")), 2)
    found = F.col("total") - F.col("missing")
    return got.join(F.broadcast(some)).select("total", found.alias("found"), "equal", "different", "missing", pct(found).alias("found_pct"), pct(F.col("equal")).alias("equal_pct"), "examples")
