"""Synthetic submissions, reproducible from a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Countries, levels gained by weight (1 is ten times as likely as 10), event spacing, whales.
GEOS = ["US", "UK", "DE", "FR", "JP", "VN"]
SPACING, WHALE_FIRST, WHALE_EVERY = 100, 240_000, 300_000


def _drawn(rows: DataFrame, users: int, seed: int) -> DataFrame:
    """``event_id, uid, g, _u``: who submits, and how much is gained, from the event's number."""
    draw = F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(55))
    # 10 + 9 + ... + 1 = 55 draws: the first ten are for 1, the next nine for 2, ...
    g = F.lit(10)
    for k in range(9, 0, -1):
        g = F.when(draw < sum(range(11 - k, 11)), F.lit(k)).otherwise(g)
    user = F.pmod(F.xxhash64("event_id", F.lit(seed + 1)), F.lit(users))
    return rows.select("*", F.concat(F.lit("user_"), user.cast("string")).alias("uid"), g.cast("long").alias("g"), user.alias("_u"))


def _home(user) -> list:
    """Team and country of a user, fixed by its number."""
    return [
        (F.pmod(F.xxhash64(user), F.lit(10)) + 1).cast("int").alias("team"),
        F.get(F.array(*[F.lit(x) for x in GEOS]), F.pmod(F.xxhash64(user, F.lit(1)), F.lit(len(GEOS))).cast("int")).alias("geo"),
    ]


def live(spark: SparkSession, rate: int, users: int = 200, seed: int = 0) -> DataFrame:
    """An endless stream of ``rate`` submissions a second, at the clock's time: ``event_id, uid, t, g, level, team, geo``.

    Without state, so ``level`` is the gain of the one submission, from 0.
    """
    rows = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    rows = _drawn(rows.select(F.col("value").alias("event_id"), F.unix_millis("timestamp").alias("t")), users, seed)
    return rows.select("event_id", "uid", "t", "g", F.col("g").alias("level"), *_home(F.col("_u")))


def generate(spark: SparkSession, n: int, users: int = 200, start: int = 1_704_067_200_000, seed: int = 0) -> DataFrame:
    """``n`` submissions ``event_id, uid, t, g, level, team, geo``; a whale comes in whenever its time has passed."""
    rows = spark.range(n).withColumnRenamed("id", "event_id")
    rows = _drawn(rows.withColumn("t", F.lit(start) + F.col("event_id") * SPACING), users, seed)
    w = Window.partitionBy("uid").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("event_id", "uid", "t", "g", F.sum("g").over(w).alias("level"), *_home(F.col("_u")))
    whales = max(0, (n * SPACING - WHALE_FIRST + WHALE_EVERY - 1) // WHALE_EVERY)
    x = F.col("id")
    big = spark.range(whales).select(
        (F.lit(n) + x).alias("event_id"), F.concat(F.lit("whale_"), x.cast("string")).alias("uid"), (F.lit(start + WHALE_FIRST) + x * WHALE_EVERY).alias("t"),
        (x + 10_000).alias("g"), (x + 10_000).alias("level"), (x % 10 + 1).cast("int").alias("team"), F.lit("US").alias("geo"),
    )
    return rows.unionByName(big)
