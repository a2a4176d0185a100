"""The keywords that gate license rules hide no match."""

from __future__ import annotations

from podium.llm import licenses

TEXTS = ["Licensed under GPLv3", "GPLv2+", "under the LGPLv3 license", "AGPLv3", "released under GPL v3", "gplv1 and lgplv2", "MIT License", "cc by sa 4.0", "SPDX-License-Identifier: GPL-3.0-only"]


def test_joined_versions(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [got[i]["labels"] for i in range(6)] == ["gpl", "gpl", "lgpl", "agpl", "gpl", "gpl,lgpl"]
    assert all(r["n_detections"] and r["score"] for r in got.values())


def test_keywords_hide_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    gated = sorted(map(tuple, licenses.detections(docs).collect()))
    every = [(p, n, label, "", x) for p, n, label, _, x in licenses.rules()]
    monkeypatch.setattr(licenses, "rules", lambda: every)
    licenses._rule_array.cache_clear()
    try:
        assert sorted(map(tuple, licenses.detections(docs).collect())) == gated
    finally:
        licenses._rule_array.cache_clear()
