"""Submissions from files, JSON texts and change-data envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import event_ms, iso_ms
from podium.operators.running import running
from podium.params import Params
from podium.schema import DEVICE, SNAPSHOT, SUBMISSION_FILE, SUBMISSION_JSON


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with ``t``, epoch milliseconds."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.withColumn("t", event_ms(F.col("ts"), rows.schema["ts"].dataType))


def gained(rows: DataFrame) -> DataFrame:
    """``event_id, uid, t, g, team, event_type``: submissions without the level, which takes a running sum; a projection only."""
    return _named(_signed(rows))


def _signed(rows: DataFrame) -> DataFrame:
    size = F.floor(F.col("value") / 10)
    return rows.select("*", F.when(F.col("event_type") == "error", -size).otherwise(size).cast("long").alias("g"))


def _named(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        "event_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("uid"), "t", "g", *more,
        (F.col("user_id") % 10 + 1).cast("int").alias("team"), "event_type",
    )


def submissions(rows: DataFrame) -> DataFrame:
    """``event_id, uid, t, g, level, team, event_type``: events as submissions; errors lower the level."""
    rows = _signed(rows).select("event_id", "user_id", "ts", "t", "g", "event_type")
    return _named(running(rows, "user_id", ["t", "ts", "event_id"], "t", Params().slice, {"level": F.col("g")}), "level")


def whole(text: Column) -> Column:
    """A JSON number's text as an int, cut towards zero; 0 for anything else, as for out of range."""
    number = F.when(F.rlike(text, F.lit(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")), text.try_cast("double"))
    return _cut(number)


def _cut(number: Column) -> Column:
    """A number cut towards zero to an int; 0 for none, and for what an int can't hold."""
    return F.coalesce(F.when(number.between(-2147483648.0, 2147483647.0), number).cast("int"), F.lit(0))


def parse_json(rows: DataFrame, value: str = "value") -> DataFrame:
    """Submissions of flat JSON texts; what can't be read or has no uid is dropped.

    Numbers that are missing or no numbers are 0; only the fields of the object itself count, not those of nested ones. ``devices`` counts only as a single object, then a list of one.
    ``t`` is null for a time that can't be read: such rows are for :func:`with_time` to drop and count.
    """
    got = rows.select(F.from_json(F.col(value), SUBMISSION_JSON, {"mode": "PERMISSIVE"}).alias("_j")).where("_j.uid IS NOT NULL")
    texts = [c for c in SUBMISSION_JSON.names if c not in ("devices", "level", "previousLevel", "team", "updatedAt")]
    device = F.when(F.rlike("_j.devices", F.lit(r"^\s*\{")), F.array(F.from_json("_j.devices", DEVICE)))
    return got.select(
        *[F.col(f"_j.{c}") for c in texts], device.alias("devices"), iso_ms(F.col("_j.updatedAt")).alias("t"),
        *[_cut(F.col(f"_j.{c}")).alias(c) for c in ("level", "previousLevel", "team")],
    )


def _date(doc: Column, field: str) -> Column:
    """Epoch milliseconds of ``{"$date": n or text}``, a number, or ISO text."""
    plain, inner = F.get_json_object(doc, f"$.{field}"), F.get_json_object(doc, f"$.{field}.$date")
    text = F.coalesce(inner, plain)
    return F.coalesce(text.try_cast("long"), iso_ms(text))


def parse_envelope(rows: DataFrame, value: str = "value") -> DataFrame:
    """Submissions of change-data envelopes, whose ``before`` and ``after`` are JSON texts; ``payload`` is optional.

    Rows without ``after`` (deletions), without a uid or with a time that can't be read are dropped. A missing
    ``before`` counts as level 0.
    """
    v = F.col(value)
    part = lambda name: F.coalesce(F.get_json_object(v, f"$.payload.{name}"), F.get_json_object(v, f"$.{name}"))
    got = rows.select(part("after").alias("_a"), part("before").alias("_b")).where("_a IS NOT NULL AND _a <> ''")
    a = F.col("_a")
    field = lambda name: F.get_json_object(a, f"$.{name}")
    got = got.select(
        F.coalesce(F.get_json_object(a, "$._id.$oid"), field("_id")).alias("_id"), field("uid").alias("uid"), field("name").alias("name"), field("geo").alias("geo"),
        whole(field("level")).alias("level"), whole(F.get_json_object("_b", "$.level")).alias("previousLevel"), whole(field("team")).alias("team"), _date(a, "updatedAt").alias("t"),
    )
    return got.where("uid IS NOT NULL AND t IS NOT NULL")


def with_time(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a time, number of rows without one as a one-row frame)."""
    return parsed.where("t IS NOT NULL"), parsed.agg(F.count_if(F.col("t").isNull()).alias("without_time"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSION_FILE).parquet(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank ones are passed over."""
    return spark.read.schema(SUBMISSION_FILE).json(path).where("uid IS NOT NULL")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot documents of JSON arrays; missing users are an empty list, of equal ids the last one counts, by the
    file's name and then the place in it (a file with an array is read by one task)."""
    rows = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
    rows = rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place")).alias("_at"))
    kind = SNAPSHOT["users"].dataType
    users = F.coalesce("users", F.array().cast(kind))
    return rows.where("_id IS NOT NULL").groupBy("_id").agg(F.max_by(users, "_at").alias("users"))


def write_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_json_arrays(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Files of one JSON array each, a document to a line; ``files=1`` gives a single array in the order of the rows."""
    lines = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))

    def wrap(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        mark = "["
        for batch in batches:
            if not batch.num_rows:
                continue
            first = pa.array([mark] + [","] * (batch.num_rows - 1))
            mark = ","
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(first, batch.column(0).cast(pa.string()), "")], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], names=["value"])

    (lines.coalesce(files) if files else lines).mapInArrow(wrap, "value string").write.mode("overwrite").text(path)


def profiles(rows: DataFrame) -> DataFrame:
    """``uid, name, geo, team, avatar``: the last known profile of each user."""
    names = ["name", "geo", "team", "avatar"]
    return rows.where("uid IS NOT NULL").groupBy("uid").agg(*[F.max_by(c, "updatedAt").alias(c) for c in names])


def stream(spark: SparkSession, kind: str, **options) -> DataFrame:
    """A streaming source: ``parquet`` or ``json`` files (path), ``rate``, or ``kafka`` if its connector is there.

    Kafka values come as a text column ``value``, from the earliest offset unless told otherwise; files can be
    paced by maxFilesPerTrigger, rates by rowsPerSecond.
    """
    reader = spark.readStream.format(kind)
    if kind == "kafka":
        options = {"startingOffsets": "earliest"} | options
    if kind in ("parquet", "json") and "schema" not in options:
        reader = reader.schema(SUBMISSION_FILE)
    elif "schema" in options:
        reader = reader.schema(options.pop("schema"))
    rows = reader.options(**options).load()
    return rows.selectExpr("CAST(value AS STRING) AS value") if kind == "kafka" else rows


#: How the producer batches, compresses, confirms and repeats.
PRODUCER = {
    "linger.ms": "200", "batch.size": str(2048 * 1024), "compression.type": "lz4", "acks": "0",
    "retries": "3", "retry.backoff.ms": "100", "request.timeout.ms": "30000",
}


def messages(rows: DataFrame) -> DataFrame:
    """``key, value``: rows as messages, keyed by uid."""
    return rows.select(F.col("uid").alias("key"), F.to_json(F.struct("*")).alias("value"))


def to_kafka(rows: DataFrame, topic: str, servers: str, checkpoint: str | None = None, **options):
    """Writes rows, or starts writing a stream of them; needs the connector on the class path.

    ``options`` override PRODUCER, by the producer's own names; with ``acks`` 0 messages may be lost, so set it to ``all`` where that matters.
    """
    told = {"kafka.bootstrap.servers": servers, "topic": topic} | {f"kafka.{k}": v for k, v in (PRODUCER | options).items()}
    if rows.isStreaming:
        return messages(rows).writeStream.format("kafka").options(**told).option("checkpointLocation", checkpoint).start()
    return messages(rows).write.format("kafka").options(**told).save()
