"""Repeated passages and near-duplicates."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.llm import components, simhash, suffix_dedup
from podium.llm.queries import op2_suffix_dedup, op9_simhash

from .conftest import DATA, SCHEMA, key, rows_of


def removed(rows, window=50):
    """(id, bytes, kept bytes, spans) by looking at every window."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - window + 1):
            if i is not None:
                first[b[s : s + window]] = min(i, first.get(b[s : s + window], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if i is not None and first[b[s : s + window]] < i:
                gone[s : s + window] = b"\1" * window
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, b, bytes(x for x, g in zip(b, gone) if not g), spans))
    return out


def as_digests(rows):
    return [(i, len(b), len(b) - len(k), spans, sha256(k).hexdigest()) for i, b, k, spans in removed(rows)]


def test_repeats(spark, messy, messy_rows, empty):
    got = suffix_dedup.digests(messy)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(as_digests([r[:2] for r in messy_rows]), key=key)
    assert suffix_dedup.digests(empty).collect() == []
    assert suffix_dedup.remove_repeats(empty).collect() == []
    cut = suffix_dedup.remove_repeats(messy)
    assert cut.schema.names == messy.schema.names
    want = sorted(((i, None if t is None else k.decode("utf-8", "ignore")) for (i, t), (_, _, k, _) in zip((r[:2] for r in messy_rows), removed([r[:2] for r in messy_rows]))), key=key)
    assert sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=key) == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.text(alphabet="ab", min_size=40, max_size=130)), min_size=1, max_size=25))
def test_repeats_in_few_letters(spark, rows):
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted(as_digests(rows))


def test_query_repeats(spark, documents):
    got = op2_suffix_dedup(spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(as_digests([(r["doc_id"], r["text"]) for r in documents.collect()]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=40))
def test_blind_trie(strings):
    trie = suffix_dedup.BlindTrie()
    for i, s in enumerate(strings):
        trie.add(s, i)
    got = list(trie.leaves())
    assert [s for s, _ in got] == sorted(set(strings))
    assert all(strings[i] == s for s, own in got for i in own) and sorted(i for _, own in got for i in own) == list(range(len(strings)))


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab", min_size=60, max_size=300), st.integers(1, 4))
def test_sorted_windows(text, groups):
    raw = np.concatenate([np.frombuffer(text.encode(), np.uint8), np.zeros(50, np.uint8)])
    at = np.arange(len(text) - 49)
    order, cls = suffix_dedup.sort_windows(raw, at, at % groups)
    by = {}
    for o, c in zip(order.tolist(), cls.tolist()):
        by.setdefault(c, []).append(o)
    got = sorted(sorted(v) for v in by.values() if len(v) > 1)
    same = {}
    for i in at.tolist():
        same.setdefault((i % groups, text[i : i + 50]), []).append(i)
    assert got == sorted(v for v in same.values() if len(v) > 1)


def brute_components(rows, width=3):
    from xxhash import xxh64_intdigest

    def fp(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
        h = [xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return [(doc, f"{f:016x}", low.get(find(i))) for i, ((doc, _), f) in enumerate(zip(rows, fps))]


def test_near_duplicates(spark, messy, messy_rows, empty):
    rows = [r[:2] for r in messy_rows]
    got = simhash.near_duplicates(messy)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_components(rows), key=key)
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.deduplicate(messy)
    assert kept.columns == messy.columns
    want = {c for _, _, c in brute_components(rows) if c is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2


def test_query_near_duplicates(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert sorted(map(tuple, op9_simhash(spark, DATA).collect())) == sorted(brute_components(rows))


def linked(fps, distance=3):
    return {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance}


def closure(pairs):
    group = {}
    for p in pairs:
        a, b = sorted(p) if len(p) == 2 else (*p, *p)
        merged = group.get(a, {a}) | group.get(b, {b})
        for x in merged:
            group[x] = merged
    return {frozenset(g) for g in group.values()}


@pytest.mark.parametrize("meeting", [4096, 7])
def test_links_span_all_pairs(spark, monkeypatch, meeting):
    """Clusters of close fingerprints, with meetings small enough to be dealt out in parts."""
    monkeypatch.setattr(simhash, "MEETING", meeting)
    rng = np.random.default_rng(1)
    fps = {0, -1}
    for centre in rng.integers(-(2**63), 2**63, 6).tolist():
        for _ in range(25):
            flip = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
            x = (centre ^ flip) & (2**64 - 1)
            fps.add(x - 2**64 if x >> 63 else x)
    classes = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(classes, 3).collect()}
    assert closure(got) == closure(linked(sorted(fps)))


@pytest.mark.parametrize("classes", [10, 10**5, 10**8, 10**12])
def test_masks_miss_no_pair(classes):
    masks = simhash.keys(3, classes)
    rng = np.random.default_rng(0)
    for _ in range(500):
        flip = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not flip & m for m in masks)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=40))
def test_components(spark, pairs):
    got = {}
    for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect():
        got.setdefault(r["root"], {r["root"]}).add(r["node"])
    assert {frozenset(g) for g in got.values()} == {g for g in closure([frozenset(p) for p in pairs]) if len(g) > 1}
    assert all(root == min(own) for root, own in got.items())


def test_long_chain(spark):
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    got = components.components(chain).collect()
    assert {r["root"] for r in got} == {0} and len(got) == 300


def test_rows_of_helper():
    assert len(rows_of(["x"])[0]) == len(SCHEMA)


@pytest.mark.parametrize("hub", [1, 5])
def test_hubs(spark, monkeypatch, hub):
    """Stars and chains with every node above a few links a hub."""
    monkeypatch.setattr(components, "HUB", hub)
    links = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(30)] + [(39, 200), (200, 201)]
    got = {}
    for r in components.components(spark.createDataFrame(links, "a long, b long")).collect():
        got.setdefault(r["root"], {r["root"]}).add(r["node"])
    assert {frozenset(g) for g in got.values()} == closure([frozenset(p) for p in links])


def test_links_of_odd_tables(spark):
    rows = spark.createDataFrame([(None,), (0,), (1,), (-1,)], "fp long")
    assert {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(rows).collect()} == {(0, 1)}
    assert simhash.links(rows.limit(0)).collect() == []
