"""Streams over files run to their end, and the live job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators import changelog, snapshots
from podium.params import Params
from podium.streaming.stores import BoardStore
from podium.streaming.topn import topn_stream
from podium.streaming.window_total import trailing_stream, window_totals

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Time of the rows that end a bounded stream (the year 2200): their watermark passes every real row.
END = 7_258_118_400_000
_END_UID = "\u0000end"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        told = f"file://{tempfile.mkdtemp(prefix='podium-')}"
    return f"{told.rstrip('/')}/podium-{name}-{uuid.uuid4().hex}"


def replay(rows: DataFrame, name: str, parts: int = 8) -> tuple[str, str]:
    """Writes ``rows`` (uid, t, ...) as files that a stream reads in the order of t, and one more that ends it; (path, schema).

    The last file has a row far in the future; drop rows of that uid from results (see :func:`real`).
    """
    spark = rows.sparkSession
    path = scratch(spark, name)
    rows.repartitionByRange(parts, "t").sortWithinPartitions("t").write.parquet(path)
    kinds = dict(rows.dtypes)
    last = spark.range(1).select(*[F.lit({"uid": _END_UID, "t": END}.get(c, 0)).cast(kinds[c]).alias(c) for c in rows.columns])
    last.coalesce(1).write.mode("append").parquet(path)
    return path, ", ".join(f"{c} {k}" for c, k in rows.dtypes)


def real(rows: DataFrame) -> DataFrame:
    return rows.where(f"uid IS NULL OR uid <> '{_END_UID}'")


def run_to_end(spark: SparkSession, stream: Callable[[], DataFrame], name: str, arrivals: tuple[Callable[[], None], ...] = (lambda: None,)) -> DataFrame:
    """Runs a stream over all that is there, into a Parquet table in the shared folder; the table.

    With several ``arrivals``, which bring new input, the stream is started again from its checkpoint after each.
    """
    path, checkpoint = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for arrive in arrivals:
            arrive()
            rows = stream()
            query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.read.schema(rows.schema).parquet(path)


def totals_stream(spark: SparkSession, source: tuple[str, str], p: Params, widths: list[int] | None = None, value: str = "sum") -> DataFrame:
    """Trailing results of a replayed stream."""
    path, schema = source
    gains = spark.readStream.schema(schema).parquet(path)
    return trailing_stream(gains.select("uid", "t", "gain"), widths or [p.window], p.watermark, value)


def board_stream(spark: SparkSession, source: tuple[str, str], p: Params) -> DataFrame:
    """Changelog and snapshots of the Top-N of users' last scores, of a replayed stream uid, t, score."""
    path, schema = source
    scores = spark.readStream.schema(schema).parquet(path)
    return topn_stream(real(scores), p)


def start_live(gains: DataFrame, p: Params, store: BoardStore, audit: str, checkpoint: str, board: str = "trailing", once: bool = False):
    """The live job: totals, then each micro-batch's Top-N against the stored board; an audit log of changes as JSON.

    ``gains``: a stream uid, t, gain. Boards and the audit log are written by batch, so a repeated batch changes nothing. With
    ``once`` the query ends when all that is there has been read.
    """

    def apply(rows: DataFrame, batch: int) -> None:
        new = window_totals(rows).groupBy("uid").agg(F.max_by("total", "t").cast("double").alias("score"), F.max("t").alias("lastUpdateTime")).withColumnRenamed("uid", "id")
        everyone = store.read(f"{board}-all")
        after = new.unionByName(everyone.join(new.select("id"), "id", "left_anti"))
        newest = after.agg(F.max("lastUpdateTime")).first()[0]
        if newest is None:
            return
        fresh = after.where(F.col("lastUpdateTime") >= newest - 2 * p.cleanup)
        top = fresh.orderBy(F.desc("score"), "lastUpdateTime", "id").limit(p.top_n)
        changes = changelog.numbered(changelog.difference(store.read(board), top)).persist()
        changes.write.mode("overwrite").json(f"{audit}/batch={batch}")  # the same batch again writes the same folder
        store.apply(board, changes, batch)
        gone = everyone.join(fresh.select("id"), "id", "left_anti").select(F.lit("DELETE").alias("change_type"), "id", "score", "lastUpdateTime")
        moves = new.select(F.lit("INSERT").alias("change_type"), "id", "score", "lastUpdateTime").unionByName(gone)
        store.apply(f"{board}-all", moves.select(F.lit(1).alias("seq"), "*"), batch)
        changes.unpersist()

    results = trailing_stream(gains, [p.window], p.watermark)
    writer = results.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def snapshot_documents(results: DataFrame) -> DataFrame:
    """``_id, users`` of a board stream's snapshots."""
    rows = results.where("kind = 'SNAPSHOT' AND seq > 0").select(F.col("taken"), F.col("seq").alias("rank"), "uid", F.col("score").alias("total"), "t")
    return snapshots.documents(rows)
