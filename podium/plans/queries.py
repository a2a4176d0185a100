"""Every board as a query over the test tables, with the same result in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podium.functions import board_key, iso_ms, iso_text, score_text
from podium.operators import boards, changelog, compare, monitor, snapshots
from podium.params import DAY, HOUR, SPARSE as P
from podium.schema import SUBMISSION_FILE
from podium.sources import generate, ingest
from podium.streaming import pipeline
from podium.streaming.metrics import Progress
from podium.streaming.stores import ParquetDocuments
from podium.streaming.window_total import hot_streaks, window_totals

Query = Callable[[SparkSession, str], DataFrame]


def _subs(spark: SparkSession, d: str) -> DataFrame:
    return ingest.submissions(ingest.events(spark, d))


def _gained(spark: SparkSession, d: str) -> DataFrame:
    """Submissions without levels, for what needs gains only."""
    return ingest.gained(ingest.events(spark, d))


def submissions(spark, d):
    return _subs(spark, d)


def level_gain(spark, d):
    rows = _subs(spark, d).select("event_id", "uid", "t", F.col("g").alias("delta"), boards.gain(F.col("level"), F.col("level") - F.col("g")).alias("gain"))
    return rows.where("gain > 0")


def peer_gains(spark, d):
    return boards.peers(_gained(spark, d))


def window_total(spark, d):
    return boards.window_total(_gained(spark, d), P)


def window_total_raw(spark, d):
    return boards.window_total_raw(_gained(spark, d), P)


def topn_window_total(spark, d):
    return boards.top_n(boards.latest(window_total(spark, d), "total"), "total", P.top_n)


def alltime_level(spark, d):
    return boards.alltime_level(_subs(spark, d))


def topn_alltime_level(spark, d):
    return boards.top_n(alltime_level(spark, d), "level", P.top_n)


def weekly_levels_gained(spark, d):
    return boards.weekly_levels_gained(_gained(spark, d))


def weekly_last_level(spark, d):
    return boards.weekly_last_level(_subs(spark, d))


def weekly_board_keys(spark, d):
    rows = weekly_levels_gained(spark, d)
    return rows.select(board_key("leaderboard_week", F.col("year"), F.col("week")).alias("key"), F.col("uid").alias("member"), F.col("levels").alias("score"))


def user_alltime_total(spark, d):
    return boards.user_alltime_total(_gained(spark, d), P)


def team_mvp(spark, d):
    return boards.team_mvp(_gained(spark, d), P)


def team_mvp_history(spark, d):
    return boards.team_mvp_history(_gained(spark, d), P)


def hot_streak(spark, d):
    return boards.hot_streak(_gained(spark, d), P)


def topn_hot_streak(spark, d):
    return boards.top_n(boards.latest(hot_streak(spark, d), "hotness"), "hotness", P.top_n)


def _span(spark, d) -> DataFrame:
    return snapshots.bounds(ingest.events(spark, d))


def snapshots_topn(spark, d):
    return snapshots.top(window_total(spark, d), P, span=_span(spark, d))


def snapshots_docs(spark, d):
    totals = window_total(spark, d)
    span = _span(spark, d)
    docs = snapshots.documents(snapshots.top(totals, P, span=span), snapshots.grid(span, P))
    return _document_text(docs)


def snapshots_flat(spark, d):
    rows = snapshots.flat(snapshots.documents(snapshots_topn(spark, d)))
    return rows.select("_id", F.col("rank").cast("long").alias("rank"), "userId", "score", iso_text(F.col("lastUpdateTime")).alias("updated"))


def snapshot_compare(spark, d):
    totals = window_total(spark, d)
    a, b = (snapshots.documents(snapshots.top(totals, P, x, _span(spark, d))) for x in (False, True))
    return compare.summary(a, b).withColumn("examples", F.concat_ws(",", F.transform("examples", lambda x: x.cast("string"))))


def snapshot_outcomes(spark, d):
    totals = window_total(spark, d)
    a, b = (snapshots.documents(snapshots.top(totals, P, x, _span(spark, d))) for x in (False, True))
    return compare.align(a, b)


def snapshot_missing(spark, d):
    """Snapshots that a set which ends with day 15 lacks."""
    docs = snapshots.documents(snapshots_topn(spark, d))
    return compare.missing(docs, docs.where(F.col("_id") < _DAY15))


def _document_text(docs: DataFrame) -> DataFrame:
    one = F.transform("users", lambda u: F.concat_ws(":", u["userId"], u["score"].cast("long").cast("string"), u["lastUpdateTime"].cast("string")))
    return docs.select(F.col("_id").alias("taken"), F.size("users").cast("long").alias("n_users"), F.array_join(one, ";").alias("users"))


def snapshots_upsert(spark, d):
    """Documents by the batch's rule, those from day 15 on replaced by the stream's rule."""
    totals = window_total(spark, d)
    a, b = (snapshots.documents(snapshots.top(totals, P, x, _span(spark, d))) for x in (False, True))
    return _document_text(snapshots.upsert(a, b.where(F.col("_id") >= _DAY15)))


def snapshot_files(spark, d):
    """Documents written as JSON arrays and read again."""
    path = pipeline.scratch(spark, "snapshots")
    ingest.write_json_arrays(snapshots.documents(snapshots_topn(spark, d)), path)
    return _document_text(ingest.read_snapshots(spark, path))


def latest_batch_top10(spark, d):
    rows = ingest.events(spark, d).select("user_id", "value", F.floor(F.col("t") / DAY).alias("day"))
    got = boards.latest_batch(rows, "day").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("average"))
    return got.orderBy(F.desc("average"), "user_id").limit(10)


def dashboard_sums(spark, d):
    rows = _gained(spark, d).select("uid", "g", boards.clipped(F.col("g")).alias("gain"))
    return boards.field_sums(rows, "uid", ["gain", "g"])


def profile_enriched_board(spark, d):
    c, n = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation"))
    names = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    profile = names.select(F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("uid"), F.col("c_name").alias("name"), F.col("n_name").alias("geo"))
    return boards.enrich(topn_alltime_level(spark, d).select("uid", "level", "rank"), profile)


def last_profiles(spark, d):
    """The last profile of each user, where names and countries change with the events."""
    rows = _gained(spark, d).select("uid", F.concat(F.lit("name "), F.col("event_id").cast("string")).alias("name"), F.col("event_type").alias("geo"), "team", F.col("uid").alias("avatar"), F.col("t").alias("updatedAt"))
    return ingest.profiles(rows)


def first_events(spark, d):
    """A limit, made definite by an order."""
    return ingest.events(spark, d).select("event_id", "event_type").orderBy("event_id").limit(100)


def rates_by_task(spark, d):
    return monitor.by_task(throughput_per_window(spark, d), "event_type", "n").withColumn("average", F.round("average", 6))


def throughput_per_window(spark, d):
    return monitor.throughput(ingest.events(spark, d), "event_type", "t", HOUR)


def counter_rates(spark, d):
    per_day = ingest.events(spark, d).groupBy("event_type", (F.floor(F.col("t") / DAY) * DAY).alias("t")).agg(F.max("event_id").alias("counter"))
    return monitor.counter_rate(per_day, "event_type", "t", "counter").select("event_type", "t", F.round("rate", 6).alias("rate"))


def score_texts(spark, d):
    rows = window_total(spark, d)
    return rows.select("uid", "t", score_text(F.col("uid"), F.col("total").cast("double"), F.col("t"), F.col("prev_total").cast("double")).alias("text"))


def _json(spark, d) -> DataFrame:
    """Submissions as texts: clicks have no uid, signups a level in quotes, views a time that can't be read."""
    kind = F.col("event_type")
    s = _subs(spark, d)
    j = F.to_json(
        F.struct(
            F.when(kind != "click", F.col("uid")).alias("uid"),
            F.when(kind == "signup", F.concat(F.lit("q"), F.col("level").cast("string"))).alias("quoted"),
            F.when(kind != "signup", F.col("level")).alias("level"),
            (F.col("level") - F.col("g")).alias("previousLevel"),
            F.when(kind == "view", "soon").otherwise(iso_text(F.col("t"))).alias("updatedAt"),
            F.col("team").alias("team"),
            # Nested fields and texts of the same names, which don't count.
            F.struct(F.lit("hi").alias("level"), F.lit("5").alias("team"), F.lit('"level":"no"').alias("fcmToken")).alias("devices"),
            F.struct(F.struct(F.lit(7).alias("level"), F.lit("x").alias("previousLevel")).alias("extra")).alias("more"),
            F.lit('{"level": "9", "team":"z"}').alias("role"),
        )
    )
    return s.select(F.regexp_replace(j, '"quoted":"q([0-9-]+)"', '"level":"$1"').alias("value"))


def _files(spark, d) -> DataFrame:
    """Submissions in the schema of files."""
    have = {"uid": F.col("uid"), "level": F.col("level"), "previousLevel": F.col("level") - F.col("g"), "team": F.col("team"), "updatedAt": iso_text(F.col("t"))}
    return _subs(spark, d).select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SUBMISSION_FILE])


def json_lines(spark, d):
    """Submissions written as JSON lines and read again."""
    path = pipeline.scratch(spark, "lines")
    ingest.write_json_lines(_files(spark, d), path)
    rows = ingest.read_json_lines(spark, path)
    return rows.select("uid", "level", "previousLevel", "team", iso_ms(F.col("updatedAt")).alias("t"))


def parquet_files(spark, d):
    """Submissions written as Parquet and read again by the explicit schema."""
    path = pipeline.scratch(spark, "files")
    ingest.write_parquet(_files(spark, d), path)
    return ingest.read_parquet(spark, path).select("uid", "level", "previousLevel", "team", iso_ms(F.col("updatedAt")).alias("t"))


def document_upsert(spark, d):
    """Submissions as documents by uid, upserted in batches of five days."""
    store = ParquetDocuments(spark, pipeline.scratch(spark, "documents"))
    rows = _files(spark, d).withColumn("_at", iso_ms(F.col("updatedAt"))).persist()
    for k in range(6):
        part = rows.where((F.col("_at") >= _DAY0 + 5 * k * DAY) & (F.col("_at") < _DAY0 + 5 * (k + 1) * DAY)).drop("_at")
        store.upsert("users", part, k)
    rows.unpersist()
    return store.read("users").select("uid", "level", "team", iso_ms(F.col("updatedAt")).alias("t"))


def generated(spark, d):
    """Generated submissions, as many as there are events: how many of whom, and what must hold of them."""
    n = ingest.events(spark, d).count()
    rows = generate.generate(spark, n)
    whale = F.col("uid").startswith("whale_")
    return rows.groupBy(F.when(whale, F.col("uid")).otherwise("user").alias("who")).agg(
        F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.max(F.when(whale, F.col("level")).otherwise(10)).alias("most"),
        F.min((F.col("g") >= 1) & (whale | (F.col("g") <= 10)) & (F.col("team") >= 1) & (F.col("team") <= 10) & (F.col("level") >= F.col("g"))).alias("holds"),
    )


def json_ingest(spark, d):
    return ingest.parse_json(_json(spark, d)).select("uid", "level", "previousLevel", "team", "t")


def cdc_ingest(spark, d):
    """Envelopes: errors have no ``after``, signups no ``before``."""
    kind, s = F.col("event_type"), _subs(spark, d)
    after = F.to_json(F.struct(F.struct(F.col("event_id").cast("string").alias("$oid")).alias("_id"), "uid", "level", "team", F.struct(F.col("t").alias("$date")).alias("updatedAt")))
    before = F.to_json(F.struct((F.col("level") - F.col("g")).alias("level")))
    env = F.to_json(F.struct(F.struct(F.when(kind != "signup", before).alias("before"), F.when(kind != "error", after).alias("after")).alias("payload")))
    return ingest.parse_envelope(s.select(env.alias("value"))).select("_id", "uid", "level", "previousLevel", "team", "t")


def board_from_changelog(spark, d):
    """Window totals as a changelog of one board: what the last change of each user leaves."""
    rows = window_total_raw(spark, d)
    kind = F.when((F.col("total") == 0) & (F.col("prev_total") > 0), "DELETE").otherwise("INSERT")
    seq = (F.col("t") * 1_000_000 + F.col("event_id")).alias("seq")
    changes = rows.select(seq, kind.alias("change_type"), F.col("uid").alias("id"), F.col("total").cast("double").alias("score"), F.col("t").alias("lastUpdateTime"), F.col("prev_total").cast("double").alias("previousScore"))
    return changelog.board(changes)


def board_difference(spark, d):
    """What turns the board of all-time levels after day 15 into the final one."""
    s = _subs(spark, d)
    as_board = lambda x: boards.alltime_level(x).select(F.col("uid").alias("id"), F.col("level").cast("double").alias("score"), F.col("t").alias("lastUpdateTime"))
    return changelog.difference(as_board(s.where(f"t < {_DAY15}")), as_board(s))


_DAY0, _DAY15 = 1_704_067_200_000, 1_705_363_200_000


def _gains(spark, d) -> DataFrame:
    return boards.level_gains(_gained(spark, d)).select("uid", "t", "gain")


def stream_window_total(spark, d):
    source = pipeline.replay(_gains(spark, d), "gains", parts=3)
    got = pipeline.run_to_end(spark, lambda: pipeline.totals_stream(spark, source, P), "totals")
    return pipeline.real(window_totals(got))


def stream_hot_streak(spark, d):
    source = pipeline.replay(_gains(spark, d), "gains", parts=3)
    got = pipeline.run_to_end(spark, lambda: pipeline.totals_stream(spark, source, P, [P.short, P.long], "ratio"), "streaks")
    return pipeline.real(hot_streaks(got))


def _board_stream(spark, d) -> DataFrame:
    scores = window_total(spark, d).select("uid", "t", F.col("total").cast("double").alias("score"))
    source = pipeline.replay(scores, "scores", parts=3)
    return pipeline.run_to_end(spark, lambda: pipeline.board_stream(spark, source, P), "board")


def stream_topn(spark, d):
    """Snapshots of the streamed board; with these parameters the stream's rule and the batch's agree."""
    rows = _board_stream(spark, d).where("kind = 'SNAPSHOT' AND seq > 0")
    return rows.select("taken", F.col("seq").cast("int").alias("rank"), "uid", F.col("score").cast("long").alias("total"), "t")


def stream_topn_changes(spark, d):
    """The streamed changelog, applied: who is on the board at the end of each day, by inserts and deletes only.

    A member's change holds until its next one; it is exploded to the days' ends in between.
    """
    rows = _board_stream(spark, d).where("kind <> 'SNAPSHOT'")
    day = F.floor(F.col("taken") / DAY)
    until = F.coalesce(F.lead(day).over(Window.partitionBy("uid").orderBy("seq")), F.lit(_DAY0 // DAY + 30))
    rows = rows.select("uid", "score", "t", "kind", day.alias("first"), until.alias("until")).where("kind = 'INSERT' AND until > first")
    held = rows.select(F.explode(F.sequence(F.col("first"), F.col("until") - 1)).alias("day"), "uid", F.col("score").cast("long").alias("total"), "t")
    return held


def stream_late_rows(spark, d):
    """Rows far behind the watermark are dropped, counted and change nothing: the second half first, then the first."""
    path, rows = pipeline.scratch(spark, "late"), _gains(spark, d)
    arrivals = tuple((lambda x=x: rows.where(x).write.mode("append").parquet(path)) for x in (F.col("t") >= _DAY15, F.col("t") < _DAY15))
    listener = Progress()
    spark.streams.addListener(listener)
    try:
        got = pipeline.run_to_end(spark, lambda: pipeline.totals_stream(spark, (path, "uid string, t bigint, gain bigint"), P), "late", arrivals)
        out = got.where("kind = 'total'").agg(F.count("*").alias("results"), F.min("t").alias("first")).withColumn("late", F.lit(listener.late(spark)))
    finally:
        spark.streams.removeListener(listener)
    return out.select("results", F.col("first") >= _DAY15, "late").toDF("results", "all_in_time", "late")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        submissions, level_gain, peer_gains, window_total, window_total_raw, topn_window_total, alltime_level, topn_alltime_level, weekly_levels_gained, weekly_last_level,
        weekly_board_keys, user_alltime_total, team_mvp, team_mvp_history, hot_streak, topn_hot_streak, snapshots_topn, snapshots_docs, snapshots_flat, snapshot_compare,
        snapshot_outcomes, snapshot_missing, snapshots_upsert, snapshot_files, last_profiles, first_events, rates_by_task, json_lines, parquet_files, document_upsert, generated,
        latest_batch_top10, dashboard_sums, profile_enriched_board, throughput_per_window, counter_rates, score_texts, json_ingest, cdc_ingest,
        board_from_changelog, board_difference, stream_window_total, stream_hot_streak, stream_topn, stream_topn_changes, stream_late_rows,
    )
}

_SUBS = """subs AS (
  SELECT event_id, concat('user_', user_id) AS uid, t, g,
         CAST(sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS level,
         CAST(user_id % 10 + 1 AS INTEGER) AS team, event_type
  FROM (SELECT *, epoch_us(ts) // 1000 AS t,
               CAST(CASE WHEN event_type = 'error' THEN -floor(value / 10) ELSE floor(value / 10) END AS BIGINT) AS g FROM events)
)"""
_PEERS = f"""{_SUBS},
peers AS (SELECT uid, t, CAST(sum(greatest(g, 0)) AS BIGINT) AS gain, count(*) AS n FROM subs GROUP BY uid, t)"""
_TOTALS = f"""{_PEERS},
totals AS (
  SELECT uid, t, total, CAST(lag(total, 1, 0) OVER (PARTITION BY uid ORDER BY t) AS BIGINT) AS prev_total
  FROM (SELECT uid, t, CAST(sum(gain) OVER (PARTITION BY uid ORDER BY t RANGE BETWEEN {P.window} PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM peers)
)"""
_RAW = f"""{_SUBS},
raw AS (
  SELECT event_id, uid, t, total, CAST(lag(total, 1, 0) OVER (PARTITION BY uid ORDER BY t, event_id) AS BIGINT) AS prev_total
  FROM (SELECT *, CAST(sum(greatest(g, 0)) OVER (PARTITION BY uid ORDER BY t RANGE BETWEEN {P.window} PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM subs)
)"""
_LEVELS = f"""{_SUBS},
levels AS (SELECT uid, arg_max(level, row(t, event_id)) AS level, max(t) AS t FROM subs GROUP BY uid)"""
_DATE = "CAST(make_timestamp(t * 1000) AS DATE)"
_WEEK = f"""{_SUBS},
weeks AS (
  SELECT *, CAST(year({_DATE}) AS INTEGER) AS year,
         CAST(ceil(dayofyear({_DATE} + CAST(6 - dayofweek({_DATE}) AS INTEGER)) / 7.0) AS INTEGER) AS week
  FROM subs
)"""
_RUNNING = f"""{_SUBS},
run AS (
  SELECT event_id, uid, team, t, greatest(g, 0) AS gain,
         CAST(sum(greatest(g, 0)) OVER (PARTITION BY uid ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total
  FROM subs
),
mvp AS (
  SELECT *, CASE WHEN mvp_total > 0 THEN holder ELSE '' END AS mvp, round(CASE WHEN team_total = 0 THEN 0.0 ELSE mvp_total / team_total END, 6) AS ratio
  FROM (
    SELECT event_id, team, t,
           arg_max(uid, row(total, -t, -event_id)) OVER w AS holder,
           max(total) OVER w AS mvp_total, CAST(sum(gain) OVER w AS BIGINT) AS team_total
    FROM run WINDOW w AS (PARTITION BY team ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)
  )
)"""
_STREAK = f"""{_PEERS},
avgs AS (
  SELECT uid, t, sum(gain) OVER s / sum(n) OVER s AS a, sum(gain) OVER l / sum(n) OVER l AS b FROM peers
  WINDOW s AS (PARTITION BY uid ORDER BY t RANGE BETWEEN {P.short} PRECEDING AND CURRENT ROW),
         l AS (PARTITION BY uid ORDER BY t RANGE BETWEEN {P.long} PRECEDING AND CURRENT ROW)
),
streak AS (SELECT uid, t, round(a, 6) AS short_avg, round(b, 6) AS long_avg, round(CASE WHEN b = 0 THEN 0.0 ELSE a / b END, 6) AS hotness FROM avgs)"""


def _snapshots(name: str, inclusive: bool) -> str:
    inside = "cutoff <= t AND t < taken" if inclusive else "cutoff < t AND t <= taken"
    return f"""{name} AS (
  SELECT snapshot, taken, CAST(row_number() OVER (PARTITION BY snapshot ORDER BY total DESC, t, uid) AS INTEGER) AS rank, uid, total, t
  FROM (SELECT snapshot, taken, uid, arg_max(total, t) AS total, max(t) AS t FROM grid JOIN totals ON {inside} GROUP BY snapshot, taken, uid)
  QUALIFY rank <= {P.top_n}
)"""


_GRID = f"""{_TOTALS},
grid AS (
  SELECT i AS snapshot, t0 + i * {P.snapshot} AS taken, CAST(t0 + greatest(0, ceil(i * {P.snapshot} / {P.cleanup}.0) - 2) * {P.cleanup} AS BIGINT) AS cutoff
  FROM (SELECT t0, unnest(range(1, (t1 - t0) // {P.snapshot} + 1)) AS i FROM (SELECT min(t) AS t0, max(t) AS t1 FROM totals))
),
{_snapshots("ranked", False)}"""
_TWO = f"""{_GRID},
{_snapshots("other", True)},
da AS (SELECT taken AS _id, list({{'u': uid, 's': total, 't': t}} ORDER BY uid, total, t) AS users FROM ranked GROUP BY taken),
db AS (SELECT taken AS _id, list({{'u': uid, 's': total, 't': t}} ORDER BY uid, total, t) AS users FROM other GROUP BY taken)"""
_DOCS = "SELECT taken, count(*) AS n_users, string_agg(concat(uid, ':', total, ':', t), ';' ORDER BY rank) AS users"
_OUTCOME = "CASE WHEN db._id IS NULL THEN 'missing' WHEN da.users = db.users THEN 'equal' ELSE 'different' END"
_ISO = "strftime(make_timestamp(x * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"

SQL: dict[str, str] = {
    "submissions": f"WITH {_SUBS} SELECT * FROM subs",
    "level_gain": f"WITH {_SUBS} SELECT event_id, uid, t, g AS delta, greatest(g, 0) AS gain FROM subs WHERE g > 0",
    "peer_gains": f"WITH {_PEERS} SELECT uid, t, gain, n FROM peers",
    "window_total": f"WITH {_TOTALS} SELECT * FROM totals",
    "window_total_raw": f"WITH {_RAW} SELECT * FROM raw",
    "topn_window_total": f"""WITH {_TOTALS}, last AS (SELECT uid, t, total FROM totals QUALIFY row_number() OVER (PARTITION BY uid ORDER BY t DESC) = 1)
        SELECT uid, t, total, CAST(row_number() OVER (ORDER BY total DESC, t, uid) AS INTEGER) AS rank FROM last QUALIFY rank <= {P.top_n}""",
    "alltime_level": f"WITH {_LEVELS} SELECT uid, level, t FROM levels",
    "topn_alltime_level": f"WITH {_LEVELS} SELECT uid, level, t, CAST(row_number() OVER (ORDER BY level DESC, t, uid) AS INTEGER) AS rank FROM levels QUALIFY rank <= {P.top_n}",
    "weekly_levels_gained": f"WITH {_WEEK} SELECT year, week, uid, CAST(sum(g) AS BIGINT) AS levels FROM weeks WHERE g > 0 GROUP BY year, week, uid",
    "weekly_last_level": f"WITH {_WEEK} SELECT year, week, uid, arg_max(level, row(t, event_id)) AS last_level, max(level) AS max_level FROM weeks GROUP BY year, week, uid",
    "weekly_board_keys": f"WITH {_WEEK} SELECT concat('leaderboard_week:', year, ':', week) AS key, uid AS member, CAST(sum(g) AS BIGINT) AS score FROM weeks WHERE g > 0 GROUP BY year, week, uid",
    "user_alltime_total": f"WITH {_RUNNING} SELECT event_id, uid, team, t, gain, total FROM run",
    "team_mvp": f"WITH {_RUNNING} SELECT team, mvp, mvp_total, team_total, ratio, t FROM mvp QUALIFY row_number() OVER (PARTITION BY team ORDER BY t DESC, event_id DESC) = 1",
    "team_mvp_history": f"""WITH {_RUNNING} SELECT event_id, team, t, mvp, mvp_total, team_total, ratio,
        lag(mvp, 1, '') OVER (PARTITION BY team ORDER BY t, event_id) AS prev_mvp FROM mvp""",
    "hot_streak": f"WITH {_STREAK} SELECT uid, t, short_avg, long_avg, hotness, lag(hotness, 1, 0.0) OVER (PARTITION BY uid ORDER BY t) AS prev_hotness FROM streak",
    "topn_hot_streak": f"""WITH {_STREAK}, last AS (SELECT uid, t, hotness FROM streak QUALIFY row_number() OVER (PARTITION BY uid ORDER BY t DESC) = 1)
        SELECT uid, t, hotness, CAST(row_number() OVER (ORDER BY hotness DESC, t, uid) AS INTEGER) AS rank FROM last QUALIFY rank <= {P.top_n}""",
    "snapshots_topn": f"WITH {_GRID} SELECT snapshot, taken, rank, uid, total, t FROM ranked",
    "snapshots_docs": f"""WITH {_GRID} SELECT grid.taken, count(uid) AS n_users,
        coalesce(string_agg(concat(uid, ':', total, ':', t), ';' ORDER BY rank), '') AS users FROM grid LEFT JOIN ranked USING (snapshot) GROUP BY grid.taken""",
    "snapshots_flat": f"WITH {_GRID} SELECT taken AS _id, CAST(rank AS BIGINT) AS rank, uid AS userId, CAST(total AS DOUBLE) AS score, {_ISO.replace('x', 't', 1)} AS updated FROM ranked",
    "snapshot_compare": f"""WITH {_TWO}, o AS (SELECT {_OUTCOME} AS outcome FROM da LEFT JOIN db ON da._id = db._id),
        c AS (SELECT count(*) AS total, count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'equal') AS equal, count(*) FILTER (outcome = 'different') AS different FROM o)
        SELECT total, total - missing AS found, equal, different, missing, round(100.0 * (total - missing) / total, 2) AS found_pct, round(100.0 * equal / total, 2) AS equal_pct,
        coalesce((SELECT string_agg(_id, ',' ORDER BY _id) FROM (SELECT da._id FROM da JOIN db ON da._id = db._id WHERE da.users <> db.users ORDER BY da._id LIMIT 10)), '') AS examples FROM c""",
    "snapshot_outcomes": f"WITH {_TWO} SELECT da._id, {_OUTCOME} AS outcome FROM da LEFT JOIN db ON da._id = db._id",
    "snapshot_missing": f"WITH {_GRID} SELECT DISTINCT taken AS _id FROM ranked WHERE taken >= {_DAY15}",
    "snapshots_upsert": f"WITH {_TWO} {_DOCS} FROM (SELECT * FROM ranked WHERE taken NOT IN (SELECT taken FROM other WHERE taken >= {_DAY15}) UNION ALL SELECT * FROM other WHERE taken >= {_DAY15}) GROUP BY taken",
    "snapshot_files": f"WITH {_GRID} {_DOCS} FROM ranked GROUP BY taken",
    "last_profiles": f"""WITH {_SUBS} SELECT uid, concat('name ', arg_max(event_id, t)) AS name, arg_max(event_type, t) AS geo, arg_max(team, t) AS team, uid AS avatar FROM subs GROUP BY uid""",
    "first_events": "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100",
    "rates_by_task": f"""SELECT event_type, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS average, count(*) AS n
        FROM (SELECT event_type, epoch_us(ts) // {HOUR * 1000} AS b, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type""",
    "json_lines": f"""WITH {_SUBS} SELECT uid, level, level - g AS "previousLevel", CAST(team AS BIGINT) AS team, t FROM subs""",
    "parquet_files": f"""WITH {_SUBS} SELECT uid, level, level - g AS "previousLevel", CAST(team AS BIGINT) AS team, t FROM subs""",
    "document_upsert": f"""WITH {_SUBS} SELECT uid, arg_max(level, t) AS level, CAST(arg_max(team, t) AS BIGINT) AS team, max(t) AS t FROM subs GROUP BY uid""",
    "generated": f"""WITH c AS (SELECT count(*) AS n FROM events),
        w AS (SELECT unnest(range(0, greatest(0, (n * {generate.SPACING} - {generate.WHALE_FIRST} + {generate.WHALE_EVERY - 1}) // {generate.WHALE_EVERY}))) AS x FROM c)
        SELECT 'user' AS who, n, {_DAY0} AS first, {_DAY0} + (n - 1) * {generate.SPACING} AS last, CAST(10 AS BIGINT) AS most, true AS holds FROM c
        UNION ALL SELECT concat('whale_', x), 1, {_DAY0} + {generate.WHALE_FIRST} + x * {generate.WHALE_EVERY}, {_DAY0} + {generate.WHALE_FIRST} + x * {generate.WHALE_EVERY}, x + 10000, true FROM w""",
    "latest_batch_top10": f"""WITH b AS (SELECT user_id, value, epoch_us(ts) // {DAY * 1000} AS day FROM events)
        SELECT user_id, round(avg(value), 6) AS average FROM b WHERE day = (SELECT max(day) FROM b) GROUP BY user_id ORDER BY average DESC, user_id LIMIT 10""",
    "dashboard_sums": f"WITH {_SUBS} SELECT uid, CAST(sum(greatest(g, 0)) AS BIGINT) AS gain, CAST(sum(g) AS BIGINT) AS g FROM subs GROUP BY uid",
    "profile_enriched_board": f"""WITH {_LEVELS}, top AS (SELECT uid, level, CAST(row_number() OVER (ORDER BY level DESC, t, uid) AS INTEGER) AS rank FROM levels QUALIFY rank <= {P.top_n})
        SELECT top.uid, level, rank, c_name AS name, n_name AS geo FROM top
        LEFT JOIN (SELECT concat('user_', c_custkey) AS uid, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey) p ON top.uid = p.uid""",
    "throughput_per_window": f"""SELECT event_type, epoch_us(ts) // {HOUR * 1000} * {HOUR} AS bucket, count(*) AS n, round(count(*) * 1000.0 / {HOUR}, 6) AS per_second
        FROM events GROUP BY 1, 2""",
    "counter_rates": f"""WITH s AS (SELECT event_type, epoch_us(ts) // {DAY * 1000} * {DAY} AS t, max(event_id) AS counter FROM events GROUP BY 1, 2),
        r AS (SELECT event_type, t, counter, lag(counter) OVER w AS c0, lag(t) OVER w AS t0 FROM s WINDOW w AS (PARTITION BY event_type ORDER BY t))
        SELECT event_type, t, round((CASE WHEN counter >= c0 THEN counter - c0 ELSE counter END) / ((t - t0) / 1000), 6) AS rate FROM r WHERE t0 IS NOT NULL""",
    "score_texts": f"""WITH {_TOTALS} SELECT uid, t, format('Score{{{{id=''{{}}'', score={{:.2f}}, lastUpdateTime={{}}, previousScore={{:.2f}}}}}}',
        uid, CAST(total AS DOUBLE), t, CAST(prev_total AS DOUBLE)) AS text FROM totals""",
    "json_ingest": f"""WITH {_SUBS} SELECT uid, CAST(CASE WHEN event_type = 'signup' THEN 0 ELSE level END AS INTEGER) AS level, CAST(level - g AS INTEGER) AS "previousLevel", team,
        CASE WHEN event_type <> 'view' THEN t END AS t FROM subs WHERE event_type <> 'click'""",
    "cdc_ingest": f"""WITH {_SUBS} SELECT CAST(event_id AS VARCHAR) AS _id, uid, CAST(level AS INTEGER) AS level,
        CAST(CASE WHEN event_type = 'signup' THEN 0 ELSE level - g END AS INTEGER) AS "previousLevel", team, t FROM subs WHERE event_type <> 'error'""",
    "board_from_changelog": f"""WITH {_RAW}, last AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY uid ORDER BY t DESC, event_id DESC) = 1)
        SELECT uid AS id, CAST(total AS DOUBLE) AS score, t AS "lastUpdateTime" FROM last WHERE NOT (total = 0 AND prev_total > 0)""",
    "board_difference": f"""WITH {_LEVELS}, old AS (SELECT uid, arg_max(level, row(t, event_id)) AS level, max(t) AS t FROM subs WHERE t < {_DAY15} GROUP BY uid)
        SELECT 'INSERT' AS change_type, l.uid AS id, CAST(l.level AS DOUBLE) AS score, l.t AS "lastUpdateTime", CAST(o.level AS DOUBLE) AS "previousScore"
        FROM levels l LEFT JOIN old o ON l.uid = o.uid WHERE o.uid IS NULL OR o.level <> l.level OR o.t <> l.t""",
}
SQL |= {
    "stream_window_total": SQL["window_total"],
    "stream_hot_streak": SQL["hot_streak"],
    "stream_topn": f"WITH {_TWO} SELECT taken, rank, uid, total, t FROM other",
    # The board of a day: the totals of the day's end, without those that the last clean-up which an event has led to took away.
    "stream_topn_changes": f"""WITH {_TOTALS},
        ends AS (SELECT day, (SELECT min(t) FROM totals) AS t0, (SELECT max(t) FROM totals WHERE t < (day + 1) * {DAY}) AS ended
                 FROM (SELECT unnest(range({_DAY0 // DAY}, {_DAY0 // DAY + 30})) AS day)),
        cut AS (SELECT day, ended, CASE WHEN ended >= t0 + 2 * {P.cleanup} THEN t0 + ((ended - t0) // {P.cleanup} - 1) * {P.cleanup} ELSE t0 END AS cutoff FROM ends),
        last AS (SELECT day, cutoff, uid, arg_max(total, t) AS total, max(t) AS t FROM cut JOIN totals ON t <= ended GROUP BY day, cutoff, uid)
        SELECT day, uid, total, t FROM last WHERE t >= cutoff QUALIFY row_number() OVER (PARTITION BY day ORDER BY total DESC, t, uid) <= {P.top_n}""",
    "stream_late_rows": f"""WITH {_SUBS} SELECT count(DISTINCT (uid, t)) FILTER (WHERE t >= {_DAY15} AND t <= (SELECT max(t) FROM subs) - {P.watermark}) AS results,
        true AS all_in_time, count(*) FILTER (WHERE t < {_DAY15}) AS late FROM subs""",
}
