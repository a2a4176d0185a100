"""The command line, and the live job over replayed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium import cli
from podium.operators import boards
from podium.params import Params
from podium.sources import ingest
from podium.streaming.stores import ParquetBoards


def test_generate_and_replay(spark, tmp_path):
    for kind in ("json", "parquet"):
        files, out = f"{tmp_path}/{kind}", f"{tmp_path}/{kind}-boards"
        cli.main([f"generate-{kind}", "--rows", "600", "--users", "4", "--out", files], spark)
        rows = spark.read.schema(ingest.SUBMISSION_FILE).format(kind).load(files)
        assert rows.count() == 600
    cli.main(["replay-parquet", "--input", f"{tmp_path}/parquet", "--boards", f"{tmp_path}/live"], spark)
    got = ParquetBoards(spark, f"{tmp_path}/live").read("trailing").collect()
    # What the watermark has passed counts; the board is that of the totals up to there.
    assert 0 < len(got) <= Params().top_n
    gains = cli.gains(ingest.read_parquet(spark, f"{tmp_path}/parquet"))
    last = max(r["lastUpdateTime"] for r in got)
    from podium.operators.running import trailing

    peers = gains.where(F.col("t") <= last).groupBy("uid", "t").agg(F.sum("gain").alias("gain"))
    totals = boards.latest(trailing(peers, "uid", "t", Params().slice, {"total": (F.col("gain"), Params().window)}), "total")
    want = {r["uid"]: r["total"] for r in totals.collect()}
    assert all(want[r["id"]] == r["score"] for r in got if r["id"] in want)
    assert spark.read.json(f"{tmp_path}/live/audit").count() >= len(got)


def test_query_and_compare(spark, tmp_path, capsys):
    cli.main(["query", "weekly_levels_gained", "--data", "/root/testdata/sf0.001", "--out", f"{tmp_path}/q"], spark)
    assert spark.read.parquet(f"{tmp_path}/q").count() > 0
    (tmp_path / "a.json").write_text('[{"_id": 1, "users": []}]')
    cli.main(["compare", "--a", f"{tmp_path}/a.json", "--b", f"{tmp_path}/a.json"], spark)
    assert "100.0" in capsys.readouterr().out
