"""Top-N changelogs, stores, comparator, ingestion, weeks, generator."""

from __future__ import annotations

import datetime
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from podium.functions import iso_text, week_number
from podium.operators import changelog, compare, monitor, snapshots
from podium.params import MINUTE, Params
from podium.sources import generate, ingest
from podium.streaming.stores import ParquetBoards
from podium.streaming.topn import Board


def board(n=3, cleanup=5 * MINUTE, snapshot=10**12):
    return Board(n, cleanup, snapshot)


def feed(b, *rows):
    return [(x[0], x[2], x[3]) for uid, score, t in rows for x in b.add(uid, float(score), t)]


def test_displacement():
    assert feed(board(), ("u1", 30, 0), ("u2", 25, 1), ("u3", 20, 2), ("u4", 27, 3)) == [
        ("INSERT", "u1", 30), ("INSERT", "u2", 25), ("INSERT", "u3", 20), ("DELETE", "u3", 20), ("INSERT", "u4", 27),
    ]


def test_update_inside():
    b = board()
    assert feed(b, ("u1", 10, 0), ("u2", 50, 1), ("u1", 20, 2)) == [("INSERT", "u1", 10), ("INSERT", "u2", 50), ("INSERT", "u1", 20)]
    assert [s for _, s, _ in b.top()] == [50, 20]


def test_outsider():
    b = board()
    feed(b, ("u1", 30, 0), ("u2", 25, 1), ("u3", 20, 2))
    assert feed(b, ("ux", 5, 3)) == []
    assert feed(b, ("ux", 27, 4)) == [("DELETE", "u3", 20), ("INSERT", "ux", 27)]
    assert feed(b, ("u4", 19, 5)) == []


def test_leaving_promotes():
    b = board()
    feed(b, ("u1", 30, 0), ("u2", 25, 1), ("u3", 20, 2), ("u4", 10, 3))
    assert feed(b, ("u2", 1, 4)) == [("DELETE", "u2", 25), ("INSERT", "u4", 10)]


def test_eviction():
    b = board()
    feed(b, ("u1", 30, 0), ("u2", 25, 30_000), ("u3", 20, MINUTE), ("u4", 18, 5 * MINUTE))
    feed(b, ("u4", 18, 10 * MINUTE))
    assert [u for u, *_ in b.top()] == ["u4"]


def test_deadlines_after_a_pause():
    """All snapshots that are due come out, in the order of time with evictions."""
    b = Board(3, 5 * MINUTE, 7 * MINUTE)
    list(b.add("u1", 1.0, 0))
    got = [x for x in b.add("u2", 2.0, 60 * MINUTE) if x[0] == "SNAPSHOT"]
    assert [x[1] for x in got] == [7 * MINUTE * k for k in range(1, 9)]
    assert got[0][2] and not got[-1][2]


def test_zero_scores_and_ties():
    b = board(2)
    feed(b, ("a", 0, 0), ("a", 5, 1), ("b", 5, 2))
    assert [u for u, *_ in b.top()] == ["a", "b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 5), st.integers(0, 40_000)), max_size=40))
def test_changelog_is_the_board(events):
    b, seen, t = Board(3, 50_000, 10**12), {}, 0
    for u, s, step in events:
        t += step
        for x in b.add(f"u{u}", float(s), t):
            if x[0] == "INSERT":
                seen[x[2]] = (x[3], x[4])
            elif x[0] == "DELETE":
                assert seen.pop(x[2], None) is not None
        assert seen == {u: (s, at) for u, s, at in b.top()}
        want = sorted(b.users.items(), key=lambda x: (-x[1][0], x[1][2]))[:3]
        assert [u for u, _ in want] == [u for u, *_ in b.top()]


CHANGES = "seq long, change_type string, id string, score double, lastUpdateTime long"


def test_applier_and_store(spark, tmp_path):
    rows = [(1, "INSERT", "a", 1.0, 1), (2, "INSERT", "b", 2.0, 1), (3, "DELETE", "a", 1.0, 1), (4, "INSERT", "c", None, 1), (5, "INSERT", "b", 3.0, 2)]
    c = spark.createDataFrame(rows, CHANGES)
    assert [tuple(r) for r in changelog.board(c).collect()] == [("b", 3.0, 2)]
    store = ParquetBoards(spark, f"file://{tmp_path}/boards")
    assert store.read("x").count() == 0
    store.apply("x", c, 0)
    store.apply("x", spark.createDataFrame([(1, "INSERT", "z", 9.0, 9)], CHANGES), 0)  # that batch was applied
    assert [r["id"] for r in store.read("x").collect()] == ["b"]
    store.apply("x", spark.createDataFrame([(1, "INSERT", "z", 9.0, 9)], CHANGES), 1)
    assert sorted(r["id"] for r in store.read("x").collect()) == ["b", "z"]
    store.apply("x", spark.createDataFrame([(7, "DELETEALL", None, None, None), (8, "INSERT", "q", 1.0, 1)], CHANGES), 2)
    assert [r["id"] for r in store.read("x").collect()] == ["q"]
    store.clear("x")
    assert store.read("x").count() == 0


def test_difference_leads_from_board_to_board(spark):
    kind = "id string, score double, lastUpdateTime long"
    a = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1), ("c", 3.0, 1)], kind)
    b = spark.createDataFrame([("b", 2.0, 1), ("c", 4.0, 2), ("d", 5.0, 2)], kind)
    got = sorted((r["change_type"], r["id"], r["score"], r["previousScore"]) for r in changelog.difference(a, b).collect())
    assert got == [("DELETE", "a", 1.0, 1.0), ("INSERT", "c", 4.0, 3.0), ("INSERT", "d", 5.0, None)]


def _docs(spark, *docs):
    kind = "_id long, users array<struct<userId: string, score: double, lastUpdateTime: long>>"
    return spark.createDataFrame(list(docs), kind)


def test_comparator(spark):
    nine = [(f"user_{k}", float(k), 100 + k) for k in range(9)]
    a = _docs(spark, (1, [("whale_2", 10002.0, 50), *nine]), (2, [*nine]), (3, None))
    b = _docs(spark, (1, [*nine, ("user_149", 29.0, 120)]), (2, [*reversed(nine)]))
    got = compare.summary(a, b).first().asDict()
    assert got == {"total": 3, "found": 2, "equal": 1, "different": 1, "missing": 1, "found_pct": 66.67, "equal_pct": 33.33, "examples": [1]}
    assert [r["_id"] for r in compare.missing(a, b).collect()] == [3]
    assert compare.summary(a.limit(0), b).first()["found_pct"] == 0.0


def test_snapshot_files(spark, tmp_path):
    f = tmp_path / "snap.json"
    f.write_text(json.dumps([{"_id": 1, "users": [{"userId": "a", "score": 1.0, "lastUpdateTime": 5}]}, {"_id": 2}, {"_id": 1, "users": []}]))
    got = {r["_id"]: r["users"] for r in ingest.read_snapshots(spark, str(f)).collect()}
    assert got == {1: [], 2: []}
    stored = snapshots.upsert(_docs(spark, (1, [("a", 1.0, 1)]), (2, [])), _docs(spark, (1, [])))
    assert {r["_id"]: len(r["users"]) for r in stored.collect()} == {1: 0, 2: 0}


def test_flat_json(spark):
    cases = {
        None: None, "{broken": None, '{"level": 1}': None, '{"uid": null}': None,
        '{"uid": 5}': ("5", 0, None, None),
        '{"uid": "a", "level": "7"}': ("a", 0, None, None),
        '{"uid": "b", "level": 3.9}': ("b", 3, None, None),
        '{"uid": "c", "level": -2, "updatedAt": "garbage"}': ("c", -2, None, None),
        '{"uid": "d", "level": null, "updatedAt": "2024-01-01T07:00:00.123456+07:00"}': ("d", 0, 1704067200123, None),
        '{"uid": "e", "updatedAt": "2024-01-01T00:00:00Z", "devices": {"fcmToken": "x"}}': ("e", 0, 1704067200000, 1),
        '{"uid": "f", "devices": [{"fcmToken": "x"}], "level": 1e20}': ("f", 0, None, None),
    }
    got = ingest.parse_json(spark.createDataFrame([(k,) for k in cases], "value string")).collect()
    assert sorted((r["uid"], r["level"], r["t"], r["devices"] and len(r["devices"])) for r in got) == sorted((v for v in cases.values() if v), key=lambda v: v[0])


def test_envelopes(spark):
    doc = lambda **x: json.dumps({"uid": "u", "level": 7, "updatedAt": {"$date": 5}} | x)
    env = lambda a, b=None, wrap=True: json.dumps({"payload": {"before": b, "after": a}} if wrap else {"before": b, "after": a})
    rows = [
        env(None), env(""), env(doc(), '{"level": 3}'), env(doc(_id={"$oid": "x"}, updatedAt={"$date": "1970-01-01T00:00:01Z"}), None, False),
        env(doc(updatedAt="never")), env(doc(updatedAt=9), "{}"), env(json.dumps({"level": 1, "updatedAt": 4})),
    ]
    got = ingest.parse_envelope(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert sorted((r["_id"], r["level"], r["previousLevel"], r["t"]) for r in got if r["_id"]) == [("x", 7, 0, 1000)]
    assert sorted((r["previousLevel"], r["t"]) for r in got if not r["_id"]) == [(0, 9), (3, 5)]


def test_weeks(spark):
    days = [datetime.date(2015, 1, 1) + datetime.timedelta(k) for k in range(0, 365 * 12)]
    got = spark.createDataFrame([(d,) for d in days], "d date").select("d", week_number(F.col("d")).alias("w")).collect()

    def week(d):
        """Weeks from Sunday; the one with the next 1 January is that year's first."""
        end = d + datetime.timedelta(days=6 - (d.weekday() + 1) % 7)
        return (end.timetuple().tm_yday + 6) // 7

    assert all(r["w"] == week(r["d"]) for r in got)
    known = {r["d"].isoformat(): r["w"] for r in got}
    assert (known["2024-12-31"], known["2024-01-07"], known["2024-01-30"]) == (1, 2, 5)


def test_iso_text(spark):
    assert spark.range(1).select(iso_text(F.lit(1704067200123))).first()[0] == "2024-01-01T00:00:00.123Z"


def test_snapshot_cutoffs_are_the_loop(spark):
    for c, s, length in ((5, 7, 100), (7, 5, 60), (3, 3, 40), (10, 4, 55)):
        p = Params(cleanup=c, snapshot=s)
        cleanups = [0, *[k * c for k in range(1, length)]]  # what the j-th cleanup at 2c + jc leaves: from (j + 1) c on
        for i, got in enumerate((r[0] for r in spark.range(1, length // s + 1).select(snapshots.cutoff(F.col("id"), p)).collect()), 1):
            done = sum(1 for j in range(length) if 2 * c + j * c < i * s)
            assert got == (cleanups[done] if done else 0)


def test_counter_rate(spark):
    got = monitor.counter_rate(spark.createDataFrame([("a", 0, 5), ("a", 1000, 9), ("a", 3000, 2)], "k string, t long, v long"), "k", "t", "v")
    assert [(r["t"], r["rate"]) for r in got.orderBy("t").collect()] == [(1000, 4.0), (3000, 1.0)]


def test_generator(spark):
    rows = generate.generate(spark, 5500, users=20, seed=3).collect()
    normal = [r for r in rows if r["uid"].startswith("user_")]
    assert len(normal) == 5500 and {r["g"] for r in normal} == set(range(1, 11))
    assert 3.5 < sum(r["g"] for r in normal) / 5500 < 4.5
    assert [r["t"] - 1_704_067_200_000 for r in rows if r["uid"].startswith("whale")] == [240_000, 540_000]
    assert sorted(rows) == sorted(generate.generate(spark, 5500, users=20, seed=3).collect())


def test_files_round_trip(spark, tmp_path):
    from podium.schema import SUBMISSION_FILE

    row = {"uid": "u", "level": 3, "previousLevel": 1, "updatedAt": "2024-01-01T00:00:00Z", "team": 2, "name": "n", "geo": "DE", "avatar": "a"}
    df = spark.createDataFrame([tuple(row.get(c) for c in SUBMISSION_FILE.names)], SUBMISSION_FILE)
    ingest.write_parquet(df, f"{tmp_path}/p")
    ingest.write_json_lines(df, f"{tmp_path}/j")
    assert ingest.read_parquet(spark, f"{tmp_path}/p").collect() == df.collect()
    assert ingest.read_json_lines(spark, f"{tmp_path}/j").select("uid", "level", "team").collect() == df.select("uid", "level", "team").collect()
    assert ingest.profiles(df).first().asDict() == {"uid": "u", "name": "n", "geo": "DE", "team": 2, "avatar": "a"}


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("kind", ["rate"])
def test_stream_source(spark, kind):
    assert ingest.stream(spark, kind, rowsPerSecond=1).isStreaming
