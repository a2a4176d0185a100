"""Scores and verdicts of the learnt operators, row by row against plain versions; figures of rows that weren't learnt from."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import zstandard

from podium.llm import quality_rules, rule_ensemble, toxicity
from podium.llm.queries import op3_toxicity, op6_rule_ensemble, op8_quality_rules

from .conftest import DATA
from .test_scores import LARGER, brute_statistics


def tables(spark, where=DATA):
    docs = spark.read.parquet(f"{where}/documents.parquet")
    return docs, spark.read.parquet(f"{where}/labels.parquet")


def test_rule_ensemble_by_hand(spark):
    docs, labels = tables(spark)
    model = rule_ensemble.fit(docs, labels)

    def of(t):
        words, lines = re.split("[ \n\t]+", t), t.split("\n")
        n, w, some = len(t), len(words), max(len(t), 1)
        return {
            "chars": n, "words": w, "word_length": n / w, "symbols": len(re.findall(r"[#*$%&|<>]", t)) / w, "capitals": sum(c.isupper() and c.istitle() or c.isupper() for c in t) / some,
            "exclamations": t.count("!") / w, "stops": (t.count(".") + t.count(",")) / w, "bars": t.count("|") / w, "lines": len(lines) / w, "distinct_words": len(set(words)) / math.sqrt(w),
            "distinct_word_share": len(set(words)) / w, "distinct_lines": len(set(lines)) / len(lines),
        }

    def score(t):
        s = of(t)
        total = model.bias
        for rule, weight in zip(model.rules, model.weights):
            total += weight * all((s[model.names[f]] <= x) == at_most for f, at_most, x in rule)
        return 1 / (1 + math.exp(-total))

    got = {r["doc_id"]: r for r in op6_rule_ensemble(spark, DATA).collect()}
    for r in docs.collect():
        want = score(r["text"] or "")
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-9 and got[r["doc_id"]]["predicted"] == (want >= 0.7)


def test_toxicity_by_hand(spark):
    docs, labels = tables(spark)
    model = toxicity.fit(docs, labels)
    p = zstandard.ZstdCompressionParameters(
        window_log=20, hash_log=20, chain_log=20, search_log=5, min_match=5, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    a, b = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p) for d in (model.toxic, model.ordinary))
    got = {r["doc_id"]: r for r in op3_toxicity(spark, DATA).collect()}
    for r in docs.orderBy("doc_id").limit(80).collect():
        words, windows = (r["text"] or "").lower().encode(), []
        for m in re.finditer(rb"\S+", words):  # one word after the other, as many to a window as fit
            w, start = m[0], m.start()
            if windows and windows[-1][1] and m.end() - windows[-1][0] <= toxicity.WINDOW:
                windows[-1] = (windows[-1][0], True, m.end())
                continue
            for k in range(0, len(w), toxicity.WINDOW):
                windows.append((start + k, len(w) - k <= toxicity.WINDOW, min(start + k + toxicity.WINDOW, m.end())))
        g = [len(b.compress(words[s:e])) - len(a.compress(words[s:e])) for s, _, e in windows]
        over = [sum(x >= v if v > 0 else x <= v for x in g) for v in toxicity.LEVELS]
        x = [math.sqrt(n) for n in over] + [n / max(len(g), 1) for n in over]
        want = 1 / (1 + math.exp(-(sum(w * v for w, v in zip(model.weights, x)) + model.bias)))
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-6


def test_quality_rules_by_hand(spark):
    docs, labels = tables(spark)
    forest = quality_rules.fit(docs, labels)
    low, high, width = forest.ranges
    log = lambda n: math.log(n) + 0.5772156649015329
    usual = 2 * log(forest.sample - 1) - 2 * (forest.sample - 1) / forest.sample

    def anomaly(t):
        n_words, chars, symbols, dup, repeated = brute_statistics(t)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
        w, c = max(n_words, 1), max(chars, 1)
        s = [symbols / c, dup / max(lines, 1), repeated / w, chars / w, len(re.findall("[A-Z]", t)) / c, len(re.findall("[0-9]", t)) / c, t.count("!") / w, len(re.findall("[,.;:]", t)) / w, n_words / max(lines, 1)]
        x = [min(max(v - h, lo - v, 0) / wd, 4) for v, lo, h, wd in zip(s, low, high, width)]
        total = 0.0
        for f, t_, length in zip(forest.feature.tolist(), forest.threshold.tolist(), forest.length.tolist()):
            node = 0
            while f[node] >= 0:
                node = 2 * node + 1 + (x[f[node]] >= t_[node])
            total += length[node]
        failed = n_words < 20 or 100 * repeated > 30 * n_words
        a = 2 ** (-total / len(forest.feature) / usual)
        return a, not failed and a <= forest.limit

    got = {r["doc_id"]: r for r in op8_quality_rules(spark, DATA).collect()}
    for r in docs.collect():
        a, kept = anomaly(r["text"] or "")
        assert abs(got[r["doc_id"]]["anomaly"] - a) < 1e-9 and (got[r["doc_id"]]["kept"] == kept or abs(a - forest.limit) < 1e-9)


def test_quality_rules_on_rows_kept_apart(spark):
    _, labels = tables(spark, LARGER)
    rows = op8_quality_rules(spark, LARGER).join(labels, "doc_id").where("NOT base_failed").collect()
    rows = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    print(f"kept {sum(good)} of {len(good)} good, {sum(bad)} of {len(bad)} bad")
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2
