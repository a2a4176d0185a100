"""Byte-level BPE, token counts and packing."""

from __future__ import annotations

import base64
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.llm import bpe, packing, token_count
from podium.llm.queries import SPECIAL, op4_token_counts, op5_packing, op10_byte_bpe

from .conftest import DATA, key

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXT = st.text(alphabet=st.one_of(st.sampled_from("abst'rdlvem SL\n\t 1٣!.é中　\xa0ß \x1c"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def packer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_encoding_is_the_library_s(library, batch):
    c = bpe.codec(RANKS)
    got = c.encode(batch)
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in batch]
    assert [c.decode(g) for g in got] == [t.encode() for t in batch]
    for g, t in zip(got, batch):
        at = c.offsets(g).tolist()
        assert [t.encode()[a:b] for a, b in zip(at, at[1:])] == [c.tokens[i] for i in g]


def test_long_pieces_and_a_small_cache(library):
    texts = ["a" * 5000, "ab" * 3000, "é" * 999, "abcdefghij" * 30, "x" * 41, "y" * 40, "…" * 200]
    c = bpe.Codec(bpe.load_ranks(RANKS))
    c.cache.limit = 5
    for _ in range(2):
        assert [g.tolist() for g in c.encode(texts)] == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 15), min_size=0, max_size=2000))
def test_scan_is_the_automaton(symbols):
    """States of the composed scan against one step after the other."""
    symbols = np.array(symbols, np.uint8)
    state, want = bpe.OPEN, []
    for s in symbols.tolist():
        state = bpe._step(bpe.OPEN if s >= bpe.N_SYMBOLS else state, s % bpe.N_SYMBOLS)[0]
        want.append(state)
    assert bpe._states(symbols, width=16).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(TEXT, st.sampled_from(["x <|endoftext|> y", "<|endoftext|><|endoftext|>", " <|endoftext|>\n"])), max_size=5))
def test_special_strings(packer, batch):
    c = bpe.codec(RANKS, SPECIAL)
    assert [g.tolist() for g in c.encode(batch)] == [e.ids for e in packer.encode_batch(batch, add_special_tokens=False)]


def test_round_trip(spark, messy, messy_rows, empty, library):
    def want(doc_id, text):
        ids = library.encode_ordinary(text or "")
        return doc_id, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((text or "").encode()).hexdigest()

    got = bpe.round_trip(messy, RANKS)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted((want(r[0], r[1]) for r in messy_rows), key=key)
    assert bpe.round_trip(empty, RANKS).collect() == []
    back = bpe.decode(bpe.encode(messy, RANKS, offsets=True), RANKS).collect()
    assert sorted((bytes(r["decoded"]) for r in back)) == sorted((r[1] or "").encode() for r in messy_rows)


def test_query_round_trip(spark, documents, library):
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in op10_byte_bpe(spark, DATA).collect()}
    assert got == {r["doc_id"]: (len(library.encode_ordinary(r["text"])), sha256(r["text"].encode()).hexdigest()) for r in documents.collect()}


def test_token_counts(spark, messy, messy_rows, empty, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = [(r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in messy_rows]
    got = token_count.token_counts(messy, P.path("piece_bpe_32k.model"), batch=100)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((*w, w[2] > 4096) for w in want), key=key)
    assert token_count.token_counts(empty, P.path("piece_bpe_32k.model")).collect() == []
    got = {r["doc_id"]: r["n_tokens"] for r in op4_token_counts(spark, DATA).collect()}
    assert got == {r["doc_id"]: len(model.encode(r["text"])) for r in documents.collect()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "é", "▁", "<s>", ".", "中", "\x00"]), max_size=60).map("".join), st.integers(1, 9))
def test_splits_lose_nothing(text, most):
    model, safe = token_count._model(P.path("piece_bpe_32k.model"))
    assert safe
    assert [i for p in token_count.split(text, most) for i in model.encode(p)] == model.encode(text)


def check_packing(rows, ids_of, length=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
        part = np.array(ids_of(r)[r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *[r["length"] for r in own[:-1]]]).tolist()
        assert sum(r["length"] for r in own) <= length
    return len(by), -(-sum(r["length"] for r in rows) // length)


def test_packing(spark, messy, messy_rows, empty, documents, packer):
    from podium.llm.queries import pack_documents

    text = {r[0]: r[1] for r in messy_rows if r[0] is not None}
    rows = pack_documents(messy).collect()
    ids = lambda t: [*packer.encode(t or "", add_special_tokens=False).ids, 0]
    known = [r for r in rows if r["doc_id"] is not None]
    used, need = check_packing(known, lambda r: ids(text[r["doc_id"]]))
    total = sum(-(-len(ids(r[1])) // 2048) for r in messy_rows)
    assert len(rows) == total and used <= need + 2
    for doc in text:
        own = sorted((r["piece"], r["start"], r["length"]) for r in known if r["doc_id"] == doc)
        assert all(n == 2048 for p, _, n in own if p)
    assert pack_documents(empty).collect() == []
    rows = op5_packing(spark, DATA).collect()
    by = {r["doc_id"]: ids(r["text"]) for r in documents.collect()}
    used, need = check_packing(rows, lambda r: by[r["doc_id"]])
    assert need <= used <= need + 1 and {r["doc_id"] for r in rows} == set(by)


def test_shards_and_islands(spark):
    """Many shards with hard problems: every piece has one place, and the islands come close to the bound."""
    rng = np.random.default_rng(3)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(20, 70, 900))]
    found = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(found, capacity=100, shard=120, islands=3, epochs=3).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == [(r[0], r[3]) for r in rows]
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 100 and len(fill) <= 1.08 * sum(r[3] for r in rows) / 100


SIZES = st.lists(st.integers(1, 100), min_size=1, max_size=60)


@settings(max_examples=100, deadline=None)
@given(SIZES, st.integers(0, 1000))
def test_operators_keep_every_item(size, seed):
    rng = np.random.default_rng(seed)
    a = packing.best_fit(sorted(range(len(size)), key=size.__getitem__), size, [], 100)
    b = packing.best_fit(list(range(len(size))), size, [], 100)
    for bins in (a, b, packing.cross(a, b, size, 100, rng), packing.mutate(a, size, 100, rng), *packing.evolve(size, [], 100, seed)):
        assert sorted(i for x in bins for i in x) == list(range(len(size)))
        assert all(sum(size[i] for i in x) <= 100 for x in bins)
    assert packing._as_bins(packing._as_array(a, len(size))) == [sorted(x) for x in a]


def test_equal_rows_are_dealt_out(spark, monkeypatch):
    """A third of all rows alike, without ids: no shard gets more than its share."""
    rows = [(None, 0, 0, 1, 7)] * 3000 + [(i, 0, 0, 30 + i % 50, i) for i in range(3000)]
    found = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    got = packing.pack(found, capacity=100, shard=300).collect()
    assert len(got) == 6000
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"] >> 32, []).append(r)
    assert len(by) == 20 and max(map(len, by.values())) < 420


def test_crossover_beats_best_fit():
    """Where best fit of falling sizes is not at the bound, the generations get closer to it."""
    better = worse = 0
    for seed in range(12):
        rng = np.random.default_rng(seed)
        size = rng.integers(20, 55, 150).tolist()
        first = len(packing.best_fit(sorted(range(150), key=size.__getitem__, reverse=True), size, [], 100))
        last = len(packing.evolve(size, [], 100, seed, generations=60)[0])
        better, worse = better + (last < first), worse + (last > first)
    assert better >= 4 and worse == 0
