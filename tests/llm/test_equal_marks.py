"""Different contents whose 64-bit marks agree stay different."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.llm import bpe, quality_rules, suffix_dedup
from podium.llm.common import numbered

from .test_scores import brute_statistics

RANKS = P.path("byte_bpe_50k.tiktoken")


def thue_morse(n):
    """Words of 2**n letters and their complements have equal polynomial marks modulo 2**64 from n = 10 on."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("n", [10, 12, 14])
def test_pieces(library, n):
    from tokenizers import Tokenizer

    packer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    x, y = thue_morse(n)
    texts = [f"x{x}x", f"x{y}x", x, y, f"z {x} and {y}", f"x{x}x"]
    c = bpe.Codec(bpe.load_ranks(RANKS))
    want = [library.encode_ordinary(t) for t in texts]
    assert want == [packer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [g.tolist() for g in c.encode(texts)] == want
    assert [c.decode(g) for g in c.encode(texts)] == [t.encode() for t in texts]
    for t, w in zip([*texts, *reversed(texts)], [*want, *reversed(want)]):  # one batch after the other
        assert c.encode([t])[0].tolist() == w


def test_pieces_under_one_mark(library, monkeypatch):
    """All pieces of one length share their mark."""
    monkeypatch.setattr(bpe, "_marks", lambda: np.zeros(0x110000, np.uint64))
    texts = ["the cat sat on the mat", "the dog ate the cat", "a cat", "eat the hat at the inn"]
    c = bpe.Codec(bpe.load_ranks(RANKS))
    for batch in (texts, texts[::-1], texts[:1], texts[1:]):
        assert [g.tolist() for g in c.encode(batch)] == [library.encode_ordinary(t) for t in batch]


@pytest.mark.parametrize("n", [10, 13])
def test_lines_and_words(n):
    x, y = thue_morse(n)
    words = " b c d e f g h"
    texts = [f"x{x}x\nx{y}x", f"x{x}x{words} x{y}x{words}", f"x{x}x{words} x{x}x{words}", f"x{x}x\nx{y}x\nx{x}x\nx{y}x", f"x{y}x\nx{x}x"]
    s = quality_rules.statistics(pa.array(texts))
    assert [tuple(int(s[c][i]) for c in quality_rules.BASE) for i in range(len(texts))] == [brute_statistics(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "\n", " ", "c d e f g h"]), max_size=40).map(" ".join), min_size=1, max_size=5))
def test_statistics_under_one_mark(texts):
    """Every word, line and passage has the same mark."""
    kept = quality_rules._mixed
    quality_rules._mixed = lambda x: np.zeros(len(x), np.uint64)
    try:
        s = quality_rules.statistics(pa.array(texts))
    finally:
        quality_rules._mixed = kept
    assert [tuple(int(s[c][i]) for c in quality_rules.BASE) for i in range(len(texts))] == [brute_statistics(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=4).map(lambda b: bytes(x % 2 for x in b)), max_size=30), st.integers(1, 3))
def test_numbers(parts, kinds):
    flat = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    marks = np.array([len(p) % kinds for p in parts], np.uint64)
    got = numbered(marks, flat, np.cumsum(sizes) - sizes, sizes)
    of = {}
    for p, n in zip(parts, got.tolist()):
        assert of.setdefault(p, n) == n
    assert len(set(of.values())) == len(of)


def test_entries_under_one_mark(monkeypatch):
    """Groups of equal entries, if all entries had one mark."""
    monkeypatch.setattr(suffix_dedup, "_MARKS", np.zeros(256, np.uint64))
    text = "".join(chr(97 + i % 7) + chr(65 + i % 11) for i in range(300))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([text, text[40:], text])], names=["doc_id", "text"])
    e = suffix_dedup.entries(batch)
    g = suffix_dedup._grouped(e.raw, e.start, e.count + 49, e.ids)
    content = [e.raw[s : s + c + 49].tobytes() for s, c in zip(e.start, e.count)]
    assert len(set(content)) == len(g.first)
    assert all(content[i] == content[g.first[k]] for i, k in enumerate(g.group))
