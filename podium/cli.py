"""Command line: generate submissions, replay files as a stream, run a registered query.

    python -m podium.cli generate-parquet --rows 10000 --out DIR
    python -m podium.cli generate-json --rows 10000 --out DIR
    python -m podium.cli replay-parquet --input DIR --boards DIR [--rate FILES]
    python -m podium.cli replay-json --input DIR --boards DIR
    python -m podium.cli replay-parquet-kafka --input DIR --servers S --topic T --checkpoint DIR [--rate FILES]
    python -m podium.cli start-producer --rate N --out DIR [--seconds S]
    python -m podium.cli start-producer --rate N --servers S --topic T --checkpoint DIR
    python -m podium.cli query NAME --data DIR [--out DIR]
    python -m podium.cli compare --a FILE --b FILE

Replays read a folder's files in order, ``--rate`` of them at a time (0: all there is). Settings come from the
environment where an option is missing: PODIUM_ROWS, PODIUM_USERS, PODIUM_SEED.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import iso_ms, iso_text
from podium.operators import boards, compare
from podium.params import Params
from podium.schema import SUBMISSION_FILE
from podium.sources import generate, ingest
from podium.streaming import pipeline
from podium.streaming.stores import ParquetBoards


def parser() -> argparse.ArgumentParser:
    env = lambda name, default: int(os.environ.get(f"PODIUM_{name}", default))
    out = argparse.ArgumentParser(prog="podium")
    verbs = out.add_subparsers(dest="verb", required=True)
    for verb in ("generate-json", "generate-parquet"):
        v = verbs.add_parser(verb)
        v.add_argument("--rows", type=int, default=env("ROWS", 10_000))
        v.add_argument("--users", type=int, default=env("USERS", 200))
        v.add_argument("--seed", type=int, default=env("SEED", 0))
        v.add_argument("--out", required=True)
    for verb in ("replay-json", "replay-parquet"):
        v = verbs.add_parser(verb)
        v.add_argument("--input", required=True)
        v.add_argument("--boards", required=True)
        v.add_argument("--rate", type=int, default=0)
    v = verbs.add_parser("replay-parquet-kafka")
    v.add_argument("--input", required=True)
    v.add_argument("--rate", type=int, default=0)
    v = [v, verbs.add_parser("start-producer")]
    v[1].add_argument("--rate", type=int, default=env("RATE", 10))
    v[1].add_argument("--users", type=int, default=env("USERS", 200))
    v[1].add_argument("--seed", type=int, default=env("SEED", 0))
    v[1].add_argument("--out", help="a folder for JSON lines, instead of a broker")
    v[1].add_argument("--seconds", type=int, help="how long; without it until stopped")
    for x in v:
        x.add_argument("--servers", default=os.environ.get("PODIUM_SERVERS"))
        x.add_argument("--topic", default=os.environ.get("PODIUM_TOPIC", "leaderboard_update"))
        x.add_argument("--checkpoint")
    v = verbs.add_parser("query")
    v.add_argument("name")
    v.add_argument("--data", required=True)
    v.add_argument("--out")
    v = verbs.add_parser("compare")
    v.add_argument("--a", required=True)
    v.add_argument("--b", required=True)
    return out


def as_files(rows: DataFrame) -> DataFrame:
    """Generated submissions in the schema of files."""
    at = iso_text(F.col("t"))
    have = {
        "uid": F.col("uid"), "geo": F.col("geo"), "name": F.col("uid"), "level": F.col("level"), "previousLevel": F.col("level") - F.col("g"), "team": F.col("team").cast("long"),
        "updatedAt": at, "updated_at": at, "created_at": at, "lastLoginAt": at,
    }
    return rows.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SUBMISSION_FILE])


def gains(rows: DataFrame) -> DataFrame:
    """``uid, t, gain`` of submissions in the schema of files; works on streams too."""
    gain = boards.gain(F.coalesce("level", F.lit(0)), F.coalesce("previousLevel", F.lit(0)))
    return rows.select("uid", iso_ms(F.col("updatedAt")).alias("t"), gain.cast("long").alias("gain"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("podium").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.verb.startswith("generate"):
        rows = as_files(generate.generate(spark, a.rows, a.users, seed=a.seed)).orderBy("updatedAt")
        (ingest.write_json_lines if a.verb.endswith("json") else ingest.write_parquet)(rows, a.out)
    elif a.verb == "replay-parquet-kafka":
        options = {"path": a.input} | ({"maxFilesPerTrigger": a.rate} if a.rate else {})
        ingest.to_kafka(ingest.stream(spark, "parquet", **options), a.topic, a.servers, a.checkpoint).awaitTermination()
    elif a.verb == "start-producer":
        rows = as_files(generate.live(spark, a.rate, a.users, a.seed))
        if a.out:
            query = rows.writeStream.format("json").option("path", a.out).option("checkpointLocation", a.checkpoint or f"{a.out}/_checkpoint").start()
        else:
            query = ingest.to_kafka(rows, a.topic, a.servers, a.checkpoint)
        if (query.awaitTermination(a.seconds) if a.seconds else query.awaitTermination()) is False:
            query.stop()
    elif a.verb.startswith("replay"):
        options = {"path": a.input} | ({"maxFilesPerTrigger": a.rate} if a.rate else {})
        source = ingest.stream(spark, a.verb.removeprefix("replay-"), **options)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipeline.ROCKS)
        query = pipeline.start_live(gains(source), Params(), ParquetBoards(spark, a.boards), f"{a.boards}/audit", f"{a.boards}/checkpoint", once=True)
        query.awaitTermination()
    elif a.verb == "query":
        from podium.plans.queries import QUERIES

        rows = QUERIES[a.name](spark, a.data)
        rows.write.mode("overwrite").parquet(a.out) if a.out else rows.show(100, False)
    else:
        compare.summary(ingest.read_snapshots(spark, a.a), ingest.read_snapshots(spark, a.b)).show(truncate=False)


if __name__ == "__main__":
    main()
