"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Texts become arrays of code points; a class table and a look at the next code point turn each into
a symbol. A symbol is a function on the states of a small splitter automaton; composition of such
functions is associative, so an array scan over the closed set of compositions gives the state
before every code point, and with it the places where a piece starts. No regex is involved. The
pieces go through a bounded cache of merge results.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from podium.llm.common import BASE, BASE_INVERSE, chunks, powers, release, same_as_before, ship, texts
from podium.llm.common import gather as slices

# Code point classes.
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
#: Code points with the Unicode property White_Space other than U+0020.
BLANKS = [0x9, 0xA, 0xB, 0xC, 0xD, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a piece of its own.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")

# States: what the code point just read leaves open.
OPEN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, PREFIX, IN_BLANKS, ONE_LEFT, TWO_LEFT = range(8)
# Symbols: a code point with what follows it.
S_OTHER, S_LETTER, S_NUMBER, S_LAST_SPACE, S_LAST_BLANK, S_BLANK, S_SHORT, S_LONG = range(8)
N_SYMBOLS, N_STATES, SIDE = 8, 8, 32


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this code point."""
    if symbol == S_LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return (OPEN if state == ONE_LEFT else ONE_LEFT), False
        return IN_LETTERS, state not in (IN_LETTERS, PREFIX)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, PREFIX)
    if symbol == S_OTHER or (symbol in (S_SHORT, S_LONG) and state in (IN_OTHERS, PREFIX)):
        return IN_OTHERS, state not in (IN_OTHERS, PREFIX)
    if symbol == S_SHORT:
        return ONE_LEFT, True
    if symbol == S_LONG:
        return TWO_LEFT, True
    if symbol == S_LAST_SPACE:  # goes before the word that follows
        return PREFIX, True
    if symbol == S_LAST_BLANK:
        return OPEN, True
    return IN_BLANKS, state != IN_BLANKS


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(composition table, element -> state map, boundary by state and symbol), all flat.

    Elements 0..7 are the symbols' functions, 8..15 the same at a text's first code point, where
    the state before is OPEN whatever came earlier. Rows of the first table are ``SIDE`` long.
    """
    maps = [tuple(_step(q, s)[0] for q in range(N_STATES)) for s in range(N_SYMBOLS)]
    maps += [(m[OPEN],) * N_STATES for m in maps]
    known, number = list(maps), {}
    for i, m in enumerate(maps):
        number.setdefault(m, i)
    done = 0
    while done < len(known):  # close the set under composition with the symbols
        for s in maps:
            f = tuple(s[q] for q in known[done])
            if f not in number:
                number[f] = len(known)
                known.append(f)
        done += 1
    assert len(known) <= SIDE
    table = np.zeros((SIDE, SIDE), np.uint8)
    for i, f in enumerate(known):
        for j, g in enumerate(known):
            table[i, j] = number[tuple(g[q] for q in f)]
    starts = np.array([[_step(q, s)[1] for s in range(N_SYMBOLS)] for q in range(N_STATES)])
    return table.ravel(), np.array(known, np.uint8).ravel(), starts.ravel()


@cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    of = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(sys.maxunicode + 1):
        if kind := kinds.get(unicodedata.category(chr(cp))[0]):
            of[cp] = kind
    of[BLANKS] = BLANK
    of[0x20] = SPACE
    return of


def _states(elements: np.ndarray, width: int = 256) -> np.ndarray:
    """The automaton's state after each element, from OPEN.

    Rows of ``width`` elements are composed side by side, one column at a time; their totals are
    composed by the same rule, which gives the state that each row starts in.
    """
    table, maps, _ = _automaton()
    n = len(elements)
    if n <= 2 * width:
        out, state, of = np.empty(n, np.uint8), OPEN, maps.tolist()
        for i, e in enumerate(elements.tolist()):
            out[i] = state = of[e * N_STATES + state]
        return out
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint8)
    padded[:n] = elements
    lanes = np.ascontiguousarray(padded.reshape(rows, width).T)
    at = np.empty(rows, np.intp)
    for j in range(1, width):
        np.multiply(lanes[j - 1], SIDE, out=at, casting="unsafe", dtype=np.intp)
        at += lanes[j]
        np.take(table, at, out=lanes[j], mode="clip")
    begin = np.zeros(rows, np.uint8)
    begin[1:] = _states(lanes[-1], width)[:-1]
    for j in range(width):
        np.multiply(lanes[j], N_STATES, out=at, casting="unsafe", dtype=np.intp)
        at += begin
        np.take(maps, at, out=lanes[j], mode="clip")
    return lanes.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start in ``points``, code points of joined texts that start at ``first``."""
    n = len(points)
    if not n:
        return np.zeros(0, np.intp)
    kind = np.take(_classes(), points, mode="clip")
    ends = np.zeros(n, bool)  # last code point of its text
    ends[first[first > 0] - 1] = True
    ends[-1] = True
    blank = kind >= SPACE
    more = ends.copy()  # blanks go on, or the text ends
    more[:-1] |= blank[1:]
    more &= blank
    symbol = np.take(np.array([S_OTHER, S_LETTER, S_NUMBER, S_LAST_SPACE, S_LAST_BLANK], np.uint8), kind)
    symbol[more] = S_BLANK
    at = np.flatnonzero(points == ord("'"))
    if len(at):
        gap = np.concatenate([points, np.zeros(2, points.dtype)])
        over = np.concatenate([ends, np.ones(2, bool)])
        one, two = np.where(over[at], 0, gap[at + 1]), np.where(over[at] | over[at + 1], 0, gap[at + 2])
        symbol[at[np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = S_SHORT
        symbol[at[np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in LONG_ENDINGS])]] = S_LONG
    elements = symbol.copy()
    elements[first] += N_SYMBOLS
    key = np.empty(n, np.uint8)
    key[1:] = _states(elements)[:-1]
    key[first] = OPEN
    key *= N_SYMBOLS
    key += symbol
    return np.flatnonzero(np.take(_automaton()[2], key, mode="clip"))


@cache
def _marks() -> np.ndarray:
    """A random 64-bit number for every code point."""
    return np.random.default_rng(11).integers(1, 1 << 63, sys.maxunicode + 1, dtype=np.uint64)


def gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the slices ``which`` of ``flat``, and where each starts in the result."""
    return slices(flat, offsets[which], offsets[which + 1] - offsets[which])


class Merges:
    """Ids of pieces that came before, found by sorted 64-bit marks; emptied at ``limit`` pieces.

    Marks only say where to look: a known piece's ids are used if all its code points are the same. A piece under
    the mark of another one is merged each time it comes.
    """

    def __init__(self, ranks: dict[bytes, int], limit: int = 600_000):
        self.pairs, self.limit = Pairs(ranks), limit
        self._empty()

    def _empty(self) -> None:
        self.marks, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.points, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def look(self, marks: np.ndarray, points: np.ndarray, begin: np.ndarray, sizes: np.ndarray, piece_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``flat, offsets, slots``: ids of each piece, slices of ``points`` in the order of their ``marks``; merges what is new."""
        if len(self.marks) + len(marks) > self.limit or max(len(self.flat), len(self.points)) > 16 * self.limit:
            self._empty()
        at = np.searchsorted(self.marks, marks)
        slots = np.zeros(len(marks), np.int64)
        known, free = np.zeros(len(marks), bool), np.ones(len(marks), bool)  # this very piece; nothing has this mark
        if len(self.marks):
            near = np.minimum(at, len(self.marks) - 1)
            free = self.marks[near] != marks
            slots = self.slots[near]
            known = ~free & (self.begin[slots + 1] - self.begin[slots] == sizes)
            of = np.flatnonzero(known)
            if len(of):  # pieces have a code point at least
                x, to = slices(points, begin[of], sizes[of])
                known[of] = np.logical_and.reduceat(x == slices(self.points, self.begin[slots[of]], sizes[of])[0], to[:-1])
        new = np.flatnonzero(~known)
        if not len(new):
            return self.flat, self.offsets, slots
        flat, offsets = self.pairs.merge([piece_of(i).encode("utf-8", "surrogatepass") for i in new.tolist()])
        slots[new] = len(self.offsets) - 1 + np.arange(len(new))
        own, to = slices(points, begin[new], sizes[new])
        self.points, self.begin = np.concatenate([self.points, own]), np.concatenate([self.begin, self.begin[-1] + to[1:]])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        self.flat = np.concatenate([self.flat, flat])
        out = self.flat, self.offsets, slots
        keep = new[free[new]]
        keep = keep[np.append(True, marks[keep][1:] != marks[keep][:-1])] if len(keep) else keep
        self.marks = np.insert(self.marks, at[keep], marks[keep])
        self.slots = np.insert(self.slots, at[keep], slots[keep])
        return out


class Pairs:
    """Merges many pieces side by side: in each round, every piece joins its pair of the lowest rank.

    Pieces of about one length are rows of a matrix. Ranks of pairs come from an open hash table of all pairs of
    tokens that make a token; after a join only the two pairs beside it are looked up anew.
    """

    #: Widths of the matrices; longer pieces are merged one by one.
    SIZES = [6, 9, 13, 18, 26, 40]

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.none = ranks, np.int32(2**31 - 1)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.side = max(ranks.values(), default=0) + 1
        found = [(a * self.side + b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        self.bits = max(4, (4 * len(found)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int32)
        keys, values = np.array([k for k, _ in found], np.int64), np.array([v for _, v in found], np.int32)
        at = self._slot(keys)
        while len(keys):  # those that find their slot taken try the next one
            free = self.keys[at] < 0
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, or ``none``."""
        keys = a.astype(np.int64) * self.side + b
        at = self._slot(keys)
        have = self.keys[at]
        out = np.where(have == keys, self.values[at], self.none)
        left = np.flatnonzero((have != keys) & (have >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            have = self.keys[at[left]]
            hit = have == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (have >= 0)]
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and where each piece's begin."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows of pieces, their ids, how many of these count
        whole, groups = [], [[] for _ in self.SIZES]
        for i, piece in enumerate(pieces):
            if piece in self.ranks:
                whole.append(i)
            elif len(piece) > self.SIZES[-1]:
                ids = merge(piece, self.ranks)
                done.append((np.array([i]), np.array([ids], np.int32), np.array([len(ids)])))
            else:
                groups[bisect_left(self.SIZES, len(piece))].append(i)
        done.append((np.array(whole, np.int64), np.array([[self.ranks[pieces[i]]] for i in whole], np.int32).reshape(-1, 1), np.ones(len(whole), np.int64)))
        for size, own in zip(self.SIZES, groups):
            if own:
                done += self._side_by_side([pieces[i] for i in own], np.array(own), size)
        sizes = np.zeros(len(pieces) + 1, np.int64)
        for rows, _, count in done:
            sizes[rows + 1] = count
        offsets = np.cumsum(sizes)
        flat = np.empty(offsets[-1], np.int32)
        for rows, ids, count in done:
            column = np.arange(ids.shape[1])
            flat[(offsets[rows][:, None] + column)[column < count[:, None]]] = ids[column < count[:, None]]
        return flat, offsets

    def _side_by_side(self, pieces: list[bytes], rows: np.ndarray, size: int):
        """Merges pieces of up to ``size`` bytes; yields (rows, ids, counts) as pieces come to their ends."""
        token = self.byte[np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8)].reshape(len(pieces), size)
        count = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rank = self.rank(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(len(pieces), size - 1)
        rank[np.arange(size - 1) >= count[:, None] - 1] = self.none
        while len(rows):
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(rows)), at]
            over = low == self.none
            if over.any():
                yield rows[over], token[over], count[over]
                live = ~over
                rows, token, rank, at, low, count = rows[live], token[live], rank[live], at[live], low[live], count[live]
                if not len(rows):
                    break
            width = token.shape[1] - 1
            token[np.arange(len(rows)), at] = low
            count = count - 1
            column = np.arange(width)
            token = np.take_along_axis(token, column + (column > at[:, None]), axis=1)
            if width == 1:
                yield rows, token, count
                break
            column = column[:-1]
            rank = np.take_along_axis(rank, column + (column >= at[:, None]), axis=1)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
            rank[before, at[before] - 1] = self.rank(token[before, at[before] - 1], token[before, at[before]])
            fresh = self.rank(token[after, at[after]], token[after, at[after] + 1])
            fresh[at[after] + 1 >= count[after]] = self.none
            rank[after, at[after]] = fresh


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Joins the adjacent pair of the lowest rank, the leftmost first, until no pair has one."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    if len(piece) > 200:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    scores = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while scores:
        low = min(scores)
        if low == none:
            break
        i = scores.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            scores[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return tuple(ranks[p] for p in parts)


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same over a linked list with a heap of pairs, for pieces of any length."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here
    left, alive = list(range(-1, n - 1)), [True] * n
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or end[i] >= n:
            continue
        j = end[i]
        if ranks.get(piece[i : end[j]]) != r:
            continue
        end[i] = end[j]
        alive[j] = False
        if end[i] < n:
            left[end[i]] = i
            if (s := ranks.get(piece[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (s, i))
        if (p := left[i]) >= 0 and (s := ranks.get(piece[p : end[i]])) is not None:
            heapq.heappush(heap, (s, p))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder over one rank file; ``special`` maps strings cut out beforehand to ids."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int] | None = None):
        self.cache, self.special = Merges(ranks), special or {}
        self.tokens = [b""] * (max(max(ranks.values(), default=0), *self.special.values(), 0) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.bytes_of = ragged(self.tokens)
        self.said = ragged([b" %d" % i for i in range(len(self.tokens))])

    def pieces(self, batch: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The joined texts, their code points, where pieces start, and the first piece of each text."""
        joined = "".join(batch)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, batch), np.intp, len(batch))
        first = np.concatenate([[0], np.cumsum(sizes)])
        starts = piece_starts(points, first[:-1][sizes > 0])
        return joined, points, starts, np.searchsorted(starts, first)

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not any(s in t for s in self.special for t in batch):
            return self._encode(batch)
        parts: list[str | int] = []  # ordinary texts, ids, and None after each text
        for text in batch:
            while text:
                at, s = min(((i, s) for s in self.special if (i := text.find(s)) >= 0), default=(len(text), ""))
                parts += [text[:at], *([self.special[s]] if s else [])]
                text = text[at + len(s) :]
            parts.append(None)
        plain = iter(self._encode([p for p in parts if isinstance(p, str)]))
        out, own = [], []
        for p in parts:
            if p is None:
                out.append(np.concatenate([np.zeros(0, np.int32), *own]))
                own = []
            else:
                own.append(next(plain) if isinstance(p, str) else np.array([p], np.int32))
        return out

    def _encode(self, batch: list[str]) -> list[np.ndarray]:
        """Pieces are ordered by a 64-bit mark; of neighbours with the same code points one is merged."""
        joined, points, starts, cut = self.pieces(batch)
        if not len(starts):
            return [np.zeros(0, np.int32) for _ in batch]
        n = len(points)
        sizes = np.diff(starts, append=n)
        ends = starts + sizes
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(np.take(_marks(), points, mode="clip") * powers(BASE, n)[:n], out=sums[1:])
        marks = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, n)[starts]
        marks ^= sizes.astype(np.uint64) << np.uint64(40)
        order = np.argsort(marks)
        marks = marks[order]
        fresh = ~same_as_before(points, starts[order], sizes[order])
        which = np.empty(len(marks), np.int64)
        which[order] = np.cumsum(fresh) - 1
        at = order[fresh]
        a, b = starts[at], ends[at]
        flat, offsets, slots = self.cache.look(marks[fresh], points, a, b - a, lambda i: joined[a[i] : b[i]])
        which = slots[which]
        ids, to = gather(flat, offsets, which)
        return [ids[a:b] for a, b in pairwise(to[cut].tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(*self.bytes_of, ids)[0].tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each id's token in the text, and the text's length."""
        return np.append(0, np.cumsum(np.diff(self.bytes_of[1])[ids]))

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by one space."""
        return gather(*self.said, ids)[0][1:].tobytes()


def ragged(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One array of all bytes, and where each part starts."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


@cache
def codec(path: str, special: tuple[tuple[str, int], ...] = ()) -> Codec:
    """One codec for each file and Python worker."""
    return Codec(load_ranks(path), dict(special))


#: Bytes of text that are held as arrays at a time.
CHUNK = 1 << 20


def encode(documents: DataFrame, path: str, offsets: bool = False) -> DataFrame:
    """``doc_id, ids array<int>`` and, if asked for, ``offsets array<long>`` (byte places, with the end).

    Null texts are empty and have no ids. Rows keep their number and multiplicity; other columns are
    ignored. Memory is bounded by ``CHUNK`` bytes of text or the longest single text.
    """
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in chunks(batches, "text", CHUNK):
            ids = c.encode(part.column("text").to_pylist())
            columns = [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))]
            if offsets:
                columns.append(pa.array([c.offsets(i) for i in ids], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "offsets"][: len(columns)])
        release()

    return texts(documents).mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", offsets array<bigint>" * offsets)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded binary`` of rows ``doc_id, ids``; null ids decode to no bytes."""
    ship(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out = [c.decode(np.array(i or [], np.int64)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """Encodes every text, decodes the ids, and returns digests of both.

    ``doc_id, n_tokens long, ids_sha256 string, decoded_sha256 string``. Same rules as :func:`encode`;
    ids never leave the worker, so the result stays small however long the texts are.
    """
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        c = codec(path)
        for part in chunks(batches, "text", CHUNK):
            counts, of_ids, of_bytes = [], [], []
            for ids in c.encode(part.column("text").to_pylist()):
                counts.append(len(ids))
                of_ids.append(sha256(c.decimals(ids)).hexdigest())
                of_bytes.append(sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        release()

    return texts(documents).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
