"""License scans, toxicity, quality classifier, quality rules."""

from __future__ import annotations

import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from podium.llm import licenses, quality_rules, rule_ensemble, toxicity
from podium.llm.queries import op1_license_scan, op3_toxicity, op6_rule_ensemble, op8_quality_rules

from .conftest import DATA, SCHEMA, key, rows_of

LARGER = "/root/testdata/sf0.1"


def base(doc_id, text):
    """The fixed part of a license scan, word by word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return doc_id, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_license_base(spark, messy, messy_rows, empty):
    got = licenses.scan(messy)
    rows = sorted((tuple(r)[:6] for r in got.collect()), key=key)
    assert rows == sorted((base(r[0], r[1]) for r in messy_rows), key=key)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got.collect())
    assert licenses.scan(empty).collect() == [] and licenses.detections(empty).collect() == []


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["mit", "MIT", "license", "Apache", "general", "public", " ", "-", "\n", "K", "é", "İ", "x"]), max_size=25).map(" ".join), max_size=15))
def test_license_places(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r)[:6] for r in licenses.scan(docs).collect()) == [base(i, t) for i, t in enumerate(texts)]


def test_license_rules(spark):
    cases = {
        "Licensed under CC BY-NC 4.0.": ("cc-by-nc", 1.0),
        "released under the terms of the GNU Lesser General Public License, version 2.1 or later": ("gpl,lgpl", 1.0),
        "SPDX-License-Identifier: BSD-3-Clause": ("bsd", 1.0),
        "Apache License 2.0": ("apache", 0.8),
        "the Mozilla Public License": ("mpl", 0.5),
        "All rights reserved.": ("proprietary", 0.5),
        "nothing of the kind, only a licence to license": ("", 0.0),
        "under the MIT License or the Apache License, Version 2.0": ("apache,mit", 1.0),
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs).collect()}
    assert got == dict(enumerate(cases.values()))
    found = licenses.detections(docs).where("doc_id = 1").collect()
    assert [(r["label"], r["first_word"], r["n_words"]) for r in found] == [("lgpl", 0, 11), ("lgpl", 6, 10)]  # what lies inside these is suppressed
    assert len(licenses.rules()) >= 200


def test_license_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = con.execute(licenses.sql())
    names = [c[0] for c in want.description]
    got = op1_license_scan(spark, DATA).select(names)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_license_plan_has_no_python(spark, documents):
    plan = licenses.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def accuracy(spark, rows, label, column):
    marks = spark.read.parquet(f"{LARGER}/labels.parquet")
    got = rows.join(marks, "doc_id").where("held_out").select("predicted", F.col(label).alias("y")).toPandas()
    return (got.predicted == got.y).mean(), got.predicted[got.y == 1].mean(), got.predicted[got.y == 0].mean()


def test_toxicity(spark):
    rows = op3_toxicity(spark, LARGER).persist()
    right, found, wrong = accuracy(spark, rows, "toxic", "predicted")
    assert right > 0.9 and found > 0.4 and wrong < 0.05
    for r in rows.limit(200).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    rows.unpersist()


def test_toxicity_edges(spark, messy, messy_rows, empty, no_labels):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for marks in (labels, no_labels):
        model = toxicity.fit(messy, marks)
        got = toxicity.score(messy, model).collect()
        assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in messy_rows), key=str)
        assert all(0 <= r["score"] <= 1 for r in got)
        assert toxicity.score(empty, model).collect() == []


def test_windows_cover_a_text():
    """Every word is in one window, in order; windows are no longer than they may be and hold no cut word that fits in one."""
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        for text in ((bytes(range(256)) * 4)[:n], bytes(rng.choice(list(b"abcdefgh  \n"), n).astype(np.uint8)), b"x" * n, b" " * n):
            ws = toxicity.windows(text)
            assert b"".join(b"".join(w.split()) for w in ws) == b"".join(text.split())
            assert all(0 < len(w) <= toxicity.WINDOW for w in ws)
            words = [w for w in text.split() if len(w) <= toxicity.WINDOW]
            assert [w for x in ws for w in x.split() if w in words] == words or any(len(w) > toxicity.WINDOW for w in text.split())


def two_kinds():
    """Windows of texts with an insult each few words, and of texts with another rare word instead."""
    rng = np.random.default_rng(0)
    word = lambda k: bytes(rng.choice(list(b"abcdefghijklmnopqrstuvwxyz"), k).astype(np.uint8))
    plain = [word(9) for _ in range(300)]
    text = lambda own: b" ".join(own if i % 6 == 2 else plain[rng.integers(300)] for i in range(80))
    return [text(b"worthless") for _ in range(60)], [text(b"gardening") for _ in range(60)]


def test_dictionaries_tell_texts_apart():
    """Each class's dictionary explains its own class; swapping the classes swaps the sign."""
    a, b = two_kinds()
    cut = lambda texts: [toxicity.windows(t) for t in texts[:40]]
    one, other = toxicity.train(cut(a), cut(b)), toxicity.train(cut(b), cut(a))
    assert len(one.toxic) == len(one.ordinary) and len(other.toxic) == len(other.ordinary)
    mean = lambda m, texts: np.mean([toxicity.gains(m, t).mean() for t in texts[40:]])
    assert mean(one, a) > 1 + mean(one, b) and mean(other, b) > 1 + mean(other, a)


def test_toxicity_learns_the_same_again(spark):
    a, b = two_kinds()
    docs = [(i, (a if i % 2 else b)[i // 2].decode()) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    a, b = (toxicity.fit(df.repartition(n), marks.repartition(n)) for n in (1, 4))
    assert a == b
    rows = toxicity.score(df, a).collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in rows]) > 0.95


def test_rule_ensemble(spark):
    rows = op6_rule_ensemble(spark, LARGER).persist()
    right, kept, wrong = accuracy(spark, rows, "quality", "predicted")
    assert right > 0.97 and kept > 0.98 and wrong < 0.1
    for r in rows.limit(100).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7)
    rows.unpersist()


def test_rule_ensemble_edges(spark, messy, messy_rows, empty, no_labels):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    for marks in (labels, no_labels):
        model = rule_ensemble.fit(messy, marks)
        got = rule_ensemble.score(messy, model)
        assert got.columns == ["doc_id", "held_out", "score", "predicted"]
        assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted((r[0] for r in messy_rows), key=str)
        assert all(0 <= r["score"] <= 1 for r in got.collect())
        kept = rule_ensemble.keep(messy, model)
        assert kept.columns == messy.columns and kept.count() == got.where("predicted = 1").count()
        assert rule_ensemble.score(empty, model).collect() == [] and rule_ensemble.keep(empty, model).collect() == []


def test_compiled_rules_are_the_model(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] <= 0.5) | (x[:, 2] > 1.5)).astype(float)
    m = rule_ensemble.fit_rows(x, y, ["a", "b", "c"])
    margin = m.bias + sum(w * rule_ensemble.holds(r, x) for r, w in zip(m.rules, m.weights))
    want = 1 / (1 + np.exp(-margin))
    assert ((want > 0.5) == y).mean() > 0.95 and all(1 <= len(r) <= 3 for r in m.rules)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r[0] for r in df.select(m.score({c: F.col(c) for c in "abc"})).collect()]
    assert np.allclose(got, want)


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {j for own in where.values() if len(own) > 1 for i in own for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "\n", " ", "#", "\r", "\x0b", "中 ", "a b ", "\n\n", "\x1c", "\x85"]), max_size=60).map("".join), min_size=1, max_size=6))
def test_statistics(texts):
    s = quality_rules.statistics(pa.array(texts))
    assert [tuple(int(s[c][i]) for c in quality_rules.BASE) for i in range(len(texts))] == [brute_statistics(t) for t in texts]


def test_quality_rules(spark, messy, messy_rows, empty, no_labels):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    for marks in (labels, no_labels):
        forest = quality_rules.fit(messy, marks)
        got = quality_rules.apply(messy, forest).collect()
        want = []
        for r in messy_rows:
            s = brute_statistics(r[1])
            want.append((r[0], *s, s[0] < 20 or 100 * s[4] > 30 * s[0]))
        assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
        assert not any(r["base_failed"] and r["kept"] for r in got)
        kept = quality_rules.keep(messy, forest)
        assert kept.columns == messy.columns and kept.count() == sum(r["kept"] for r in got)
        assert quality_rules.apply(empty, forest).collect() == [] and quality_rules.keep(empty, forest).collect() == []


def test_query_quality_rules(spark, documents):
    got = {r["doc_id"]: r for r in op8_quality_rules(spark, LARGER).collect()}
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").collect()
    good = [got[r["doc_id"]] for r in docs if r["quality"] == 1]
    bad = [got[r["doc_id"]] for r in docs if r["quality"] == 0]
    assert np.mean([not r["kept"] and not r["base_failed"] for r in good]) < 0.005
    assert np.mean([r["kept"] for r in bad]) < 0.1


def test_forest_isolates_the_unusual():
    rng = np.random.default_rng(1)
    rows = np.zeros((1000, len(quality_rules.SHARES)))
    rows[:, 0] = rng.random(1000) * 0.1
    odd = rows[:5].copy()
    odd[:, 0] = 0.9
    ranges = quality_rules.ordinary(rows)
    forest = quality_rules.grow(np.concatenate([rows, odd]), ranges)
    scores = forest.scores(np.concatenate([rows, odd]))
    assert scores[1000:].min() > scores[:1000].max()
    cut = quality_rules.calibrate(forest, scores, np.arange(1005) < 1000)
    assert scores[:1000].max() <= cut.limit < scores[1000:].min()
    assert quality_rules.calibrate(forest, scores[:1000], np.ones(1000, bool)).limit == np.inf


@pytest.mark.skipif(not os.path.exists(LARGER), reason="no larger tables")
def test_schema_helper(spark):
    assert spark.createDataFrame(rows_of(["x"]), SCHEMA).count() == 1
