"""Rates over time, for the counters that a running job exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.operators.running import previous
from podium.params import DAY


def throughput(rows: DataFrame, by: str, time: str, width: int) -> DataFrame:
    """``by, bucket, n, per_second``: rows of each time bucket of ``width`` milliseconds."""
    bucket = (F.floor(F.col(time) / width) * width).alias("bucket")
    got = rows.groupBy(by, bucket).agg(F.count("*").alias("n"))
    return got.withColumn("per_second", F.round(F.col("n") * 1000.0 / width, 6))


def counter_rate(samples: DataFrame, by: str, time: str, value: str, span: int = 30 * DAY) -> DataFrame:
    """``by, time, rate``: increase per second of a counter since the sample before; a smaller value is a restart from 0."""
    rows = previous(samples.select(by, time, value, F.struct(value, time).alias("_now")), by, time, span, "_now", "_before", None)
    before, since = F.col(f"_before.{value}"), (F.col(time) - F.col(f"_before.{time}")) / 1000
    rise = F.when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    return rows.select(by, time, (rise / since).alias("rate")).where("rate is not null")


def by_task(rows: DataFrame, task: str, value: str) -> DataFrame:
    """``task, total, average, n``: a rate's sum and mean over the instances of each task."""
    return rows.groupBy(task).agg(F.sum(value).alias("total"), F.avg(value).alias("average"), F.count(value).alias("n"))
