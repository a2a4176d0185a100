"""The corpus pipeline, stage by stage, against brute force on what each stage got."""

from __future__ import annotations

import corpus_pipeline
from podium.llm.common import staged

from .conftest import DATA
from .test_duplicates import closure, removed
from .test_scores import brute_statistics


def one_of_each(rows, width=5):
    """The smallest id of each component of texts whose sets of shingles share 80 % or more."""
    sets = []
    for doc, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((doc, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}))
    pairs = {frozenset((a, b)) for i, (a, x) in enumerate(sets) for b, y in sets[: i + 1] if 100 * len(x & y) >= 80 * len(x | y)}
    return {min(g) for g in closure(pairs)}


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, DATA), name)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        outs.append(out)
        docs = out
    first, second, third, fourth, last = ([r.asDict() for r in o.collect()] for o in outs)
    assert 0 < len(second) <= len(first) <= 200
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in first}
    assert sum(q == 1 and i not in kept for i, q in marks.items()) <= 0.05 * len(marks)
    for r in second:
        s = brute_statistics(r["text"])
        assert s[0] >= 20 and 100 * s[4] <= 30 * s[0]
    want = one_of_each([(r["doc_id"], r["text"]) for r in second])
    assert {r["doc_id"] for r in third} == want and len(third) == len(want)
    cut = {i: k.decode("utf-8", "ignore") for i, _, k, _ in removed([(r["doc_id"], r["text"]) for r in third])}
    assert {r["doc_id"]: r["text"] for r in fourth} == cut
    assert {r["doc_id"] for r in last} == set(cut)
    by = {}
    for r in last:
        by[r["sequence_id"]] = by.get(r["sequence_id"], 0) + r["length"]
    assert max(by.values()) <= 2048 and len(by) <= -(-sum(by.values()) // 2048) + 1


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_odd_tables(spark, messy, empty, no_labels, tmp_path):
    """Every stage over null and empty texts, ties, repeated rows and clashing columns, and over an empty table."""
    for docs in (messy, empty):
        for name, stage in corpus_pipeline.STAGES[2:]:
            out = staged(stage(spark, docs, DATA), name)
            assert name == "best_fit_packing" or out.columns == docs.columns
            docs = out if name != "best_fit_packing" else docs
    for name, table in (("documents", messy), ("labels", no_labels)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[0] == "doc_id"
    empty.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
