"""Ordinary ranges and the forest's limit come from all labelled documents, not from a part of them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from podium.llm import quality_rules
from podium.llm.quality_rules import SHARES

#: Only the documents from here on have digits: a part by a hash of 6000 good ones misses most of them.
N, ODD = 14_000, 13_960


def _text(i):
    return " ".join(f"{'abcdefghij'[(i * 7 + k * k) % 10] * (1 + (i + k) % 7)}{'9' * (i >= ODD)}{'.' * (k % 9 == 0)}{'!#' * (i % 5 == 0 and i < ODD and k % 3 == 0)}" for k in range(20 + i % 13))


@pytest.fixture(scope="module")
def rows():
    return [(i, _text(i), int(i % 5 > 0 or i >= ODD)) for i in range(N)]


@pytest.fixture(scope="module")
def tables(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, label int")
    return d.select("doc_id", "text"), d.select("doc_id", F.col("label").alias("quality"))


def _learnt(spark, docs, labels):
    s = quality_rules._with_statistics(docs, []).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 <> 2").orderBy("doc_id").toPandas()
    s = s[(s["n_words"] >= 20) & (100 * s["n_repeat_words"] <= 30 * s["n_words"])]
    return s[SHARES].to_numpy(float), s["quality"].to_numpy() == 1


def test_ranges_and_limit_of_all_rows(spark, tables):
    docs, labels = tables
    forest = quality_rules.fit(docs, labels)
    x, good = _learnt(spark, docs, labels)
    assert good.sum() > 6000
    want = quality_rules.ordinary(x[good])
    assert np.allclose(forest.ranges, want, rtol=1e-12, atol=1e-15)
    scores = forest.scores(x)
    assert 0 < forest.limit < 1
    assert abs(forest.limit - quality_rules.calibrate(forest, scores, good).limit) < 1e-12


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1999, 2001, 4003])
def test_exact_ranks(spark, n):
    rng = np.random.default_rng(n)
    x = np.stack([np.round(rng.normal(size=n), 1 + k % 4) for k in range(len(SHARES))], axis=1)  # with many ties and with few
    table = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in SHARES))
    assert np.allclose(quality_rules.ordinary_of(table), quality_rules.ordinary(x), rtol=1e-12, atol=1e-15)


@pytest.mark.parametrize("seed", range(6))
def test_limit_of_a_table(spark, seed):
    """Few and many parts, both classes and one: the limit of the plain rule."""
    rng = np.random.default_rng(seed)
    x, good = rng.random((400, len(SHARES))) * rng.integers(0, 2, (400, 1)), rng.random(400) < (1.0 if seed == 0 else 0.0 if seed == 1 else 0.8)
    x[~good] *= 1.5
    forest = quality_rules.grow(x, quality_rules.ordinary(x[:3] * 0.1), trees=20, sample=64, seed=seed)
    table = spark.createDataFrame([(*map(float, r), int(g)) for r, g in zip(x, good)], ", ".join(f"{c} double" for c in SHARES) + ", label int")
    want = quality_rules.calibrate(forest, forest.scores(x), good).limit
    for parts in (1, 16, 1024):
        assert quality_rules.calibrate_on(forest, table, parts=parts).limit == pytest.approx(want, abs=1e-12)


def test_samples_share_no_row():
    x = np.arange(1.0, 41.0)[:, None] * np.ones(len(SHARES))
    forest = quality_rules.grow(x, np.stack([np.zeros(len(SHARES)), np.zeros(len(SHARES)), np.full(len(SHARES), 100.0)]), trees=4, sample=10)
    assert forest.sample == 10 and len(forest.feature) == 4
