"""Keys with many rows get slices of their own; stores write changes only; nested fields of JSON don't count."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from podium import cli
from podium.operators import monitor, running
from podium.schema import SUBMISSION_FILE
from podium.sources import ingest
from podium.streaming.stores import ParquetBoards, ParquetDocuments

ROWS = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400), st.integers(-3, 5)), min_size=1, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, most=st.sampled_from([1, 4, 15]))
def test_own_slices_change_nothing(spark, monkeypatch, rows, most):
    monkeypatch.setattr(running, "MOST", most)
    s = spark.createDataFrame([(i, f"u{max(0, u - 1)}", t, g) for i, (u, t, g) in enumerate(rows)], "event_id long, uid string, t long, g long")
    order = Window.partitionBy("uid").orderBy("t", "event_id")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    want = s.select("event_id", F.sum("g").over(w).alias("x"), F.max("g").over(w).alias("y"), F.lag("g", 1, 99).over(order).alias("p"), F.sum("g").over(Window.partitionBy("uid").orderBy("t").rangeBetween(-20, 0)).alias("r")).collect()
    got = running.running(s, "uid", ["t", "event_id"], "t", 1000, {"x": F.col("g")}, {"y": F.col("g")})
    got = running.previous(got, "uid", "t", 1000, "g", "p", 99, ["t", "event_id"])
    got = running.trailing(got, "uid", "t", 1000, {"r": (F.col("g"), 20)}).select("event_id", "x", "y", "p", "r").collect()
    assert sorted(got) == sorted(want)


def test_a_hot_key_has_many_slices(spark, monkeypatch):
    monkeypatch.setattr(running, "MOST", 100)
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("hot").alias("k"), F.col("id").alias("t"))
    got = {r["k"]: r["n"] for r in running.sliced(rows, "k", "t", 10_000).groupBy("k", "_slice").count().groupBy("k").agg(F.max("count").alias("n")).collect()}
    assert got["hot"] <= 110 and all(n == 1 for k, n in got.items() if k != "hot")


def test_nested_fields_do_not_count(spark):
    cases = {
        '{"uid":"a","level":5,"devices":{"level":"hi"},"team":3}': (5, 0, 3),
        '{"uid":"b","devices":{"level":7,"team":2}}': (0, 0, 0),
        '{"uid":"c","level":"7","extra":{"level":3},"previousLevel":3.9}': (0, 3, 0),
        '{"uid":"d","level":1e20,"team":2147483648,"previousLevel":-2147483648}': (0, -2147483648, 0),
        '{"uid":"e","role":"\\"level\\":\\"x\\"","level":4,"team":true,"previousLevel":null}': (4, 0, 0),
        '{"uid":"f","level":{"level":1},"team":[1],"previousLevel":"NaN"}': (0, 0, 0),
        '{"uid":"g", "level" : -3.9, "previousLevel":2147483647}': (-3, 2147483647, 0),
    }
    got = ingest.parse_json(spark.createDataFrame([(k,) for k in cases], "value string")).orderBy("uid").collect()
    assert [(r["level"], r["previousLevel"], r["team"]) for r in got] == list(cases.values())


def test_boards_write_changes_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ParquetBoards, "COMPACT", 3)
    store, want = ParquetBoards(spark, f"file://{tmp_path}/boards"), {}
    kind = "seq long, change_type string, id string, score double, lastUpdateTime long"
    for batch in range(8):
        rows = [(1, "INSERT", f"u{batch}", float(batch), batch), (2, "INSERT", "same", float(batch), batch)]
        want |= {f"u{batch}": float(batch), "same": float(batch)}
        if batch >= 2:
            rows.append((3, "DELETE", f"u{batch - 2}", None, None))
            del want[f"u{batch - 2}"]
        for _ in range(2):  # a repeated batch changes nothing
            store.apply("x", spark.createDataFrame(rows, kind), batch)
        assert {r["id"]: r["score"] for r in store.read("x").collect()} == want
    assert len(store._folders("x")) <= 8
    base, changes = store._live("x")
    assert base and len(changes) < 3


def test_documents(spark, tmp_path):
    store = ParquetDocuments(spark, f"file://{tmp_path}/documents")
    doc = lambda **x: tuple(x.get(c) for c in SUBMISSION_FILE.names)
    store.upsert("users", spark.createDataFrame([doc(uid="a", level=1, updatedAt="2024-01-01"), doc(uid="a", level=2, updatedAt="2024-01-02"), doc(uid="b", level=9, updatedAt="2024-01-01"), doc(level=5)], SUBMISSION_FILE), 0)
    store.upsert("users", spark.createDataFrame([doc(uid="b", level=10, updatedAt="2024-01-03")], SUBMISSION_FILE), 1)
    assert sorted((r["uid"], r["level"]) for r in store.read("users").collect()) == [("a", 2), ("b", 10)]


def test_json_arrays(spark, tmp_path):
    kind = "_id long, users array<struct<userId: string, score: double, lastUpdateTime: long>>"
    docs = spark.createDataFrame([(k, [("u", float(k), k)] if k % 2 else None) for k in range(10)], kind)
    ingest.write_json_arrays(docs.orderBy("_id"), f"{tmp_path}/one", 1)
    (file,) = [f for f in (tmp_path / "one").iterdir() if f.name.startswith("part")]
    assert [d["_id"] for d in json.loads(file.read_text())] == list(range(10))
    ingest.write_json_arrays(docs.repartition(3), f"{tmp_path}/many")
    for path in ("one", "many"):
        assert {r["_id"]: len(r["users"]) for r in ingest.read_snapshots(spark, f"{tmp_path}/{path}").collect()} == {k: k % 2 for k in range(10)}
    ingest.write_json_arrays(docs.limit(0), f"{tmp_path}/none")
    assert ingest.read_snapshots(spark, f"{tmp_path}/none").count() == 0


def test_last_duplicate_by_file_and_place(spark, tmp_path):
    for name, score in (("a", 1.0), ("b", 2.0)):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"_id": 1, "users": []}, {"_id": 1, "users": [{"userId": name, "score": score, "lastUpdateTime": 1}]}]))
    assert [r["users"][0]["userId"] for r in ingest.read_snapshots(spark, str(tmp_path)).collect()] == ["b"]


def test_producer(spark, tmp_path):
    cli.main(["start-producer", "--rate", "50", "--users", "5", "--out", f"{tmp_path}/live", "--seconds", "8"], spark)
    rows = spark.read.schema(SUBMISSION_FILE).json(f"{tmp_path}/live").where("uid is not null")
    assert rows.count() > 0 and rows.select("uid").distinct().count() <= 5
    got = ingest.messages(rows).first()
    assert got["key"] == json.loads(got["value"])["uid"]
    assert set(ingest.PRODUCER) >= {"batch.size", "acks", "retries", "linger.ms", "compression.type"}


def test_rates_by_task(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("b", None)], "task string, v long")
    assert sorted((r["task"], r["total"], r["average"], r["n"]) for r in monitor.by_task(rows, "task", "v").collect()) == [("a", 4, 2.0, 2), ("b", None, None, 0)]


@pytest.mark.parametrize("verb", ["start-producer", "replay-parquet-kafka"])
def test_broker_verbs(verb):
    more = ["--input", "x"] if verb.startswith("replay") else []
    a = cli.parser().parse_args([verb, *more, "--servers", "h:1", "--topic", "t", "--checkpoint", "c", "--rate", "3"])
    assert (a.servers, a.topic, a.checkpoint, a.rate) == ("h:1", "t", "c", 3)
