"""Changelogs of boards: INSERT, DELETE and DELETEALL rows, and the boards that they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_changes(changes: DataFrame) -> DataFrame:
    """What remains to be done: the last change of each member after the last DELETEALL; rows without a score that
    would insert are passed over."""
    spark = changes.sparkSession
    rows = spark.sql("SELECT * FROM {c} WHERE change_type <> 'DELETEALL' AND seq > coalesce((SELECT max(seq) FROM {c} WHERE change_type = 'DELETEALL'), -1)", c=changes)
    rows = rows.where("id IS NOT NULL AND (change_type = 'DELETE' OR score IS NOT NULL)")
    names = ["change_type", "score", "lastUpdateTime"]
    return rows.groupBy("id").agg(F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in names])


def board(changes: DataFrame) -> DataFrame:
    """``id, score, lastUpdateTime`` of the board after all changes."""
    return last_changes(changes).where("change_type = 'INSERT'").select("id", "score", "lastUpdateTime")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """``change_type, id, score, lastUpdateTime, previousScore``: from one board (id, score, lastUpdateTime) to the next."""
    old = before.select("id", F.col("score").alias("_s"), F.col("lastUpdateTime").alias("_t"), F.lit(True).alias("_old"))
    rows = old.join(after.withColumn("_new", F.lit(True)), "id", "full_outer")
    changed = F.col("_old").isNull() | F.col("_new").isNull() | ~F.col("_s").eqNullSafe(F.col("score")) | ~F.col("_t").eqNullSafe(F.col("lastUpdateTime"))
    gone = F.col("_new").isNull()
    return rows.where(changed).select(
        F.when(gone, "DELETE").otherwise("INSERT").alias("change_type"), "id", F.when(gone, F.col("_s")).otherwise(F.col("score")).alias("score"),
        F.when(gone, F.col("_t")).otherwise(F.col("lastUpdateTime")).alias("lastUpdateTime"), F.col("_s").alias("previousScore"),
    )


def numbered(changes: DataFrame, start: int = 0) -> DataFrame:
    """Adds ``seq``: deletions first, then by time and member."""
    w = Window.orderBy(F.col("change_type") != "DELETE", "lastUpdateTime", "id")
    return changes.withColumn("seq", F.row_number().over(w) + F.lit(start))
