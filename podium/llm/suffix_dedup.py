"""Removal of repeated passages: every byte covered by a string of WINDOW bytes that also starts in a
document with a smaller id.

Documents are written once as blocks of a few megabytes. In a block, neighbouring windows whose
smallest k-mer mark is the same form an entry; equal windows have equal marks wherever they are, so the mark
decides where windows meet. First only the marks travel, one row for each mark of a block, and each block learns
which of its marks occur in another block at all. Then the entries of those marks travel, equal ones once for
each block. Where they meet, their suffixes are sorted by the deep-shallow scheme: multikey sorting by
CHARACTER bytes at a time down to SHALLOW, then blind tries for the groups that still agree. Each block gets back, for the
entries of which a smaller id has a window, one bit for each window. Texts stay in their blocks, and rows grow in
proportion to them.

Under a mark with more than HOT entries, as of a phrase that every text has with other words around it, windows travel one
by one instead, and meet by all of their bytes: an aggregation that starts before the shuffle, so no task depends on how
frequent a phrase or a passage is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import BASE, BASE_INVERSE, BLOB_ROWS, bucketed, chunks, gather, numbered, powers, release, ship, staged, tasks_for

WINDOW, KMER, SHALLOW = 50, 16, 30
#: Bytes of a character of the multikey sort, and windows of an entry at most.
CHARACTER, LONGEST = 5, 64
#: Bytes of text in a block; entries under one mark from which windows meet one by one; bytes that meet side by side.
BLOCK, HOT, TOGETHER = 4 << 20, 1 << 15, 4 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MARKS = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(raw: np.ndarray, at: np.ndarray | None = None, order: str = "<") -> np.ndarray:
    """The eight bytes from each place on, as numbers; ``raw`` has eight bytes of padding at least."""
    view = np.ndarray(len(raw) - 7, f"{order}u8", raw.data, 0, (1,))
    return view[at].astype(np.uint64) if at is not None else view


#: Places whose marks are computed at a time, so that the steps between need little memory.
PIECE = 1 << 18


def window_marks(raw: np.ndarray) -> np.ndarray:
    """The smallest 40-bit k-mer mark of the window that starts at each place of ``raw``; its last WINDOW
    places have none. Equal windows have equal marks."""
    if len(raw) < PIECE + WINDOW:
        return _piece_marks(raw)
    pieces = [_piece_marks(raw[a : a + PIECE + WINDOW - 1])[:PIECE] for a in range(0, len(raw) - WINDOW + 1, PIECE)]
    return np.concatenate(pieces)


def _piece_marks(raw: np.ndarray) -> np.ndarray:
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(KMER + 8, np.uint8)])
    w = _words(padded)
    h = w[:n] * _A
    h ^= h >> np.uint64(29)
    h *= _B
    h += w[8 : n + 8] * _A
    h ^= h >> np.uint64(32)
    h *= _B
    h >>= np.uint64(24)
    width, have = WINDOW - KMER + 1, 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < width:
        h = np.minimum(h[: len(h) - (width - have)], h[width - have :])
    return h


@dataclass
class Entries:
    """Runs of up to LONGEST windows with one mark, in a block's joined texts."""

    raw: np.ndarray  # padded
    offsets: np.ndarray  # of texts
    start: np.ndarray
    count: np.ndarray  # windows
    mark: np.ndarray
    ids: np.ndarray  # of the entry's document


def entries(batch: pa.RecordBatch) -> Entries:
    """Rows with a null id have no part in any comparison and so no entries."""
    text = pa.compute.fill_null(batch.column("text"), "").cast(pa.large_binary())
    ids = batch.column("doc_id").cast(pa.int64())
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = pa.compute.fill_null(ids, 0).to_numpy()
    _, at, data = text.buffers()
    offsets = np.frombuffer(at, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]] if len(offsets) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n, sizes = len(raw), np.diff(offsets)
    long = np.flatnonzero((sizes >= WINDOW) & known)
    if not len(long):
        none = np.zeros(0, np.int64)
        return Entries(np.concatenate([raw, np.zeros(WINDOW, np.uint8)]), offsets, none, none, none.astype(np.uint64), none)
    mark = window_marks(raw)
    first, last = offsets[long], offsets[long + 1] - WINDOW
    inside = np.zeros(len(mark) + 1, np.int8)
    inside[first] += 1
    np.add.at(inside, last + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    begin = inside.copy()
    begin[1:] &= mark[1:] != mark[:-1]
    begin[first] = True
    finish = inside.copy()
    finish[:-1] &= begin[1:] | ~inside[1:]
    start = np.flatnonzero(begin)
    count = np.flatnonzero(finish) + 1 - start
    if (count > LONGEST).any():
        parts = -(-count // LONGEST)
        into = _ragged(np.zeros(len(start), np.int64), parts) * LONGEST
        count = np.minimum(np.repeat(count, parts) - into, LONGEST)
        start = np.repeat(start, parts) + into
    own = ids[long][np.searchsorted(first, start, side="right") - 1]
    return Entries(np.concatenate([raw, np.zeros(WINDOW, np.uint8)]), offsets, start, count, mark[start], own)


def _table(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as s:
        return s.read_next_batch()


def _blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _blocks(documents: DataFrame) -> tuple[DataFrame, int]:
    """``block, bytes, data``: whole rows, a few megabytes of text together, and the bytes of all texts. Written before use, so
    that what a block holds never changes, and in buckets, so that blocks needn't be sent to meet their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 20
        for part in chunks(batches, "text", BLOCK):
            n = pa.compute.sum(pa.compute.binary_length(part.column("text"))).as_py() or 0
            # A slice's buffers may reach beyond it; take() copies what it needs.
            own = part.take(pa.array(range(part.num_rows)))
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([n], pa.int64()), pa.array([_blob(own)], pa.binary())], names=["block", "bytes", "data"])
            at += 1
        release()

    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = documents.mapInArrow(run, "block bigint, bytes bigint, data binary")
    return bucketed(rows, "blocks", "block", tasks_for(documents.sparkSession, total, 4 * BLOCK), **BLOB_ROWS), total


def _in_several(e: Entries) -> np.ndarray:
    """Entries whose mark two documents of the block have."""
    order = np.argsort(e.mark)
    mark, ids = e.mark[order], e.ids[order]
    if not len(mark):
        return np.zeros(0, bool)
    new = np.append(True, mark[1:] != mark[:-1])
    first = np.flatnonzero(new)
    out = np.empty(len(mark), bool)
    out[order] = (np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first))[np.cumsum(new) - 1]
    return out


def _ragged(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ..., begin[1], ...: ``sizes`` places from each."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begin - before, sizes) + np.arange(int(sizes.sum()))


@dataclass
class Groups:
    """Equal slices of a block."""

    group: np.ndarray  # of each slice
    first: np.ndarray  # number of the first slice of each group
    smallest: np.ndarray  # id of each group


def _grouped(raw: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> Groups:
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.take(_MARKS, raw, out=sums[1:], mode="clip")
    sums[1:] *= powers(BASE, n)[:n]
    np.cumsum(sums, out=sums)
    key = (sums[start + size] - sums[start]) * powers(BASE_INVERSE, n)[start] + size.astype(np.uint64) * _B
    key ^= key >> np.uint64(31)
    _, first, group = np.unique(numbered(key, raw, start, size), return_index=True, return_inverse=True)
    smallest = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(smallest, group, ids)
    return Groups(group, first, smallest)


def _binary(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Slices of ``raw`` as a binary column."""
    data, to = gather(raw, start, size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


#: Numbers of entries fit below a block's number.
_N = 20


def _send_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mark, own``: each mark of a block, with the block's number and the number of different entries under the mark."""
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
            e = entries(_table(data.as_py()))
            order = np.argsort(e.mark)
            first = np.flatnonzero(np.append(True, e.mark[order][1:] != e.mark[order][:-1])[: len(order)])
            mark, n = e.mark[order[first]], np.diff(np.append(first, len(order)))
            many = order[np.repeat(n > 1, n)]
            if len(many):  # equal entries count once
                g = _grouped(e.raw, e.start[many], e.count[many] + WINDOW - 1, e.ids[many])
                again, times = np.unique(e.mark[many[g.first]], return_counts=True)
                n[np.searchsorted(mark, again)] = times
            own = (block << _N) + np.minimum(n, (1 << _N) - 1)
            for a in range(0, len(mark), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(mark[a : a + (1 << 16)].view(np.int64)), pa.array(own[a : a + (1 << 16)])], names=["mark", "own"])
            release()


def _meet_marks(hot_from: int):
    """``block, mark, hot`` of marks that several blocks have; rows come in the order of marks. Of a mark no more rows are
    held than make it hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        mark, own, known = none, none, None
        for batch in chain(batches, [None]):
            out = []
            if batch is not None:
                new, more = batch.column("mark").to_numpy(), batch.column("own").to_numpy()
                if known is not None:  # more rows of the hot mark that the last batch ended with
                    n = int(np.searchsorted(new, known, side="right"))
                    out.append((more[:n], new[:n], np.ones(n, bool)))
                    new, more = new[n:], more[n:]
                    known = None if len(new) else known
                mark, own = np.concatenate([mark, new]), np.concatenate([own, more])
            end = len(mark)
            if batch is not None and end:
                end = int(np.searchsorted(mark, mark[-1]))
                if (own[end:] & ((1 << _N) - 1)).sum() > hot_from and len(own) - end > 1:
                    known, end = int(mark[-1]), len(mark)
            m, o = mark[:end], own[:end]
            if len(m):
                first = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
                times = np.diff(np.append(first, len(m)))
                hot = np.repeat(np.add.reduceat(o & ((1 << _N) - 1), first) > hot_from, times)
                keep = np.repeat(times, times) > 1
                out.append((o[keep], m[keep], hot[keep]))
            mark, own = mark[end:], own[end:]
            for o, m, hot in out:
                yield pa.RecordBatch.from_arrays([pa.array(o >> _N), pa.array(m), pa.array(hot)], names=["block", "mark", "hot"])
        release()

    return run


_ENTRY, _HOT_WINDOW = ("mark bigint, block bigint, at int, least bigint, data binary", "block bigint, at int, several boolean, least bigint, data binary")


def _send_entries(hot: bool):
    """Different entries of a block under the marks that it shares, or with ``hot`` different windows under its hot marks.

    ``at`` is the place of the first one in the block, ``least`` the smallest id that has it. Of windows, ``several`` tells
    whether other ids of the block have it too.
    """

    none = _empty(_HOT_WINDOW if hot else _ENTRY)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [none]
        shared, is_hot = right["mark"].to_numpy().view(np.uint64), right["hot"].to_numpy()
        for block, data in zip(left["block"].to_pylist(), left["data"]):
            e = entries(_table(data.as_py()))
            of_hot = np.isin(e.mark, shared[is_hot])
            if hot:
                use = np.flatnonzero(of_hot)
                start, size = _ragged(e.start[use], e.count[use]), np.full(int(e.count[use].sum()), WINDOW)
                ids, mark = np.repeat(e.ids[use], e.count[use]), np.repeat(e.mark[use], e.count[use])
            else:
                use = np.flatnonzero((np.isin(e.mark, shared) | _in_several(e)) & ~of_hot)
                start, size, ids, mark = e.start[use], e.count[use] + WINDOW - 1, e.ids[use], e.mark[use]
            if not len(start):
                continue
            g = _grouped(e.raw, start, size, ids)
            columns = {"block": np.full(len(g.first), block), "at": start[g.first].astype(np.int32), "least": g.smallest}
            if hot:
                most = np.full(len(g.first), np.iinfo(np.int64).min)
                np.maximum.at(most, g.group, ids)
                columns["several"] = most > g.smallest
            else:
                columns["mark"] = mark[g.first].view(np.int64)
            columns["data"] = _binary(e.raw, start[g.first], size[g.first])
            out.append(pa.table({k: columns[k] for k in none.schema.names}))
            del e, g, start, size, ids, columns
        release()
        return pa.concat_tables(out)

    return run


def _same_as_first(raw: np.ndarray, at: np.ndarray, lead: np.ndarray, depth: int) -> np.ndarray:
    """Whether windows agree with their group's first window from ``depth`` on."""
    out = np.ones(len(at), bool)
    for d in [*range(depth, WINDOW - 8, 8), WINDOW - 8]:
        out &= _words(raw, at + d) == _words(raw, lead + d)
    return out


class BlindTrie:
    """Strings of one length in order; inner nodes know only the place where their strings branch."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, s: bytes, member: int) -> None:
        if self.root is None:
            self.root = [None, s, [member]]
            return
        node, path = self.root, []
        while node[0] is not None:  # blind: only branching bytes are looked at
            path.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        if node[1] == s:
            node[2].append(member)
            return
        at = next(i for i, (x, y) in enumerate(zip(s, node[1])) if x != y)
        leaf, branch = [None, s, [member]], node[1][at]
        above = [n for n in path if n[0] < at]
        below = path[len(above)] if len(above) < len(path) else node
        if below[0] == at:
            below[1][s[at]] = leaf
            return
        new = [at, {branch: below, s[at]: leaf}]
        if above:
            above[-1][1][s[above[-1][0]]] = new
        else:
            self.root = new

    def leaves(self) -> Iterator[tuple[bytes, list[int]]]:
        """(string, members) in order."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                yield node[1], node[2]
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))


def sort_windows(raw: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, class) of the windows of ``raw`` that start at ``at``, in order within each group.

    Equal windows of a group get one class number. Windows that are alone after the shallow sort are left out.
    """
    order, own = np.arange(len(at)), np.unique(group, return_inverse=True)[1].astype(np.uint64)
    for depth in range(0, SHALLOW, CHARACTER):  # one more character of the multikey sort
        key = _words(raw, at[order] + depth, ">") >> np.uint64(64 - 8 * CHARACTER)
        if len(own) and own.max() >> np.uint64(64 - 8 * CHARACTER):
            by = np.lexsort((key, own))
            new = np.append(True, (own[by][1:] != own[by][:-1]) | (key[by][1:] != key[by][:-1]))
        else:  # group and character in one number
            key |= own << np.uint64(8 * CHARACTER)
            by = np.argsort(key)
            key = key[by]
            new = np.append(True, key[1:] != key[:-1])[: len(by)]
        order, number = order[by], np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1 if len(order) else new
        order, number = order[several], number[several]
        own = (np.cumsum(np.append(True, number[1:] != number[:-1])[: len(number)]) - 1).astype(np.uint64)
    own = own.astype(np.int64)
    if not len(order):
        return order, own
    new = np.append(True, own[1:] != own[:-1])
    number = np.cumsum(new) - 1
    lead = at[order[np.flatnonzero(new)]][number]
    even = np.bincount(number, ~_same_as_first(raw, at[order], lead, SHALLOW)) == 0
    mixed = np.flatnonzero(~even[number])  # groups that the deep sort has to order
    cls = number.copy()
    fresh = int(number[-1]) + 1
    if len(mixed):
        bounds = np.flatnonzero(np.append(True, number[mixed][1:] != number[mixed][:-1])).tolist()
        flat, places = raw.tobytes(), at[order[mixed]].tolist()
        for a, b in zip(bounds, [*bounds[1:], len(mixed)]):
            trie = BlindTrie()
            for i in range(a, b):
                trie.add(flat[places[i] + SHALLOW : places[i] + WINDOW], i)
            members: list[int] = []
            classes: list[int] = []
            for _, own_members in trie.leaves():
                members += own_members
                classes += [fresh] * len(own_members)
                fresh += 1
            where = mixed[a:b]
            order[where] = order[mixed[members]]
            cls[where] = classes
    return order, cls


_TOLD = "block bigint, at int, bits bigint"


def _meet_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each entry, one bit for each window, the first one lowest: a smaller id than the entry's own has it. Entries
    without any are left out.

    Rows come in the order of marks; whole marks are looked at together, some megabytes at a time.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
            size += batch.column("data").nbytes
        if not held or (batch is not None and size < TOGETHER):
            continue
        t = pa.Table.from_batches(held)
        mark = t["mark"].to_numpy()
        end = t.num_rows if batch is None else int(np.searchsorted(mark, mark[-1]))
        if end:
            yield from _told(t.slice(0, end))
            rest = t.slice(end)
            held = rest.combine_chunks().to_batches()
            size = sum(b.column("data").nbytes for b in held)
            release()


def _told(t: pa.Table) -> Iterator[pa.RecordBatch]:
    least = t["least"].to_numpy()
    data = t["data"].combine_chunks()
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
    _, offsets, body = data.buffers()
    offsets = np.frombuffer(offsets, np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]
    start, count = offsets[:-1] - offsets[0], np.diff(offsets) - (WINDOW - 1)
    flat, of = raw.tobytes(), {}
    number = np.array([of.setdefault(flat[a:b], len(of)) for a, b in zip(start.tolist(), (start + count + WINDOW - 1).tolist())])  # equal entries of all blocks are one
    own = np.full(len(of), np.iinfo(np.int64).max)
    np.minimum.at(own, number, least)
    first = np.zeros(len(of), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    # Entries that are alone under their mark have no further company.
    _, under, times = np.unique(t["mark"].to_numpy()[first], return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[under] > 1)
    raw = np.concatenate([raw, np.zeros(WINDOW, np.uint8)])
    c = count[first[some]]
    at, whose = _ragged(start[first[some]], c), np.repeat(some, c)
    order, cls = sort_windows(raw, at, under[whose])
    best = np.repeat(own, count[first])  # smallest id of each window of the distinct entries
    place = np.cumsum(count[first]) - count[first]
    if len(order):
        low = np.full(int(cls.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, cls, own[whose[order]])
        best[(place[whose] + at - start[first[whose]])[order]] = low[cls]
    bit = best[_ragged(place[number], count)] < np.repeat(least, count)
    bits = np.add.reduceat(bit.astype(np.uint64) << _ragged(np.zeros(len(count), np.int64), count).astype(np.uint64), np.cumsum(count) - count)
    hit = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(t["block"].to_numpy()[hit]), pa.array(t["at"].to_numpy()[hit]), pa.array(bits[hit].view(np.int64))], names=["block", "at", "bits"])


def _removed(e: Entries, at: np.ndarray, bits: np.ndarray, hot_at: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Which bytes of the block go, by what came back of its entries (place of the first one, bits) and of its windows under
    hot marks (place of the first one, whether a smaller id has it)."""
    n = int(e.offsets[-1])
    hits = []
    use = np.flatnonzero(np.isin(e.mark, e.mark[np.searchsorted(e.start, at)]) | _in_several(e))
    if len(use):
        count = e.count[use]
        g = _grouped(e.raw, e.start[use], count + WINDOW - 1, e.ids[use])
        of_group = np.zeros(len(g.first), np.uint64)
        by = np.argsort(g.first)  # as places in the block
        of_group[by[np.searchsorted(e.start[use[g.first[by]]], at)]] = bits.view(np.uint64)
        into = _ragged(np.zeros(len(use), np.int64), count)
        hit = (np.repeat(of_group[g.group], count) >> into.astype(np.uint64)) & np.uint64(1) > 0
        hit |= np.repeat(e.ids[use] > g.smallest[g.group], count)
        hits.append((np.repeat(e.start[use], count) + into)[hit])
    if len(hot_at):
        under = np.searchsorted(e.start, hot_at, side="right") - 1  # the entry that the window is part of
        use = np.flatnonzero(np.isin(e.mark, e.mark[under]))
        window, ids = _ragged(e.start[use], e.count[use]), np.repeat(e.ids[use], e.count[use])
        g = _grouped(e.raw, window, np.full(len(window), WINDOW), ids)
        bit = np.isin(window[g.first], hot_at[smaller])
        hits.append(window[bit[g.group] | (ids > g.smallest[g.group])])
    starts = np.zeros(n, bool)
    for window in hits:
        starts[window] = True
    cover = np.zeros(n + 1, np.int32)
    cover[:n] += starts
    cover[WINDOW:n] -= starts[: n - WINDOW] if n > WINDOW else starts[:0]
    return np.cumsum(cover[:-1]) > 0


def _run(documents: DataFrame, result: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], schema) -> DataFrame:
    """``result`` (rows, bytes' offsets, removed bytes) of every block."""
    spark = documents.sparkSession
    ship(spark)
    blocks, total = _blocks(documents)
    tasks = tasks_for(spark, total, 12 << 20)
    texts = blocks.select("block", "data")
    marks = texts.mapInArrow(_send_marks, "mark bigint, own bigint").repartition(tasks, "mark").sortWithinPartitions("mark")
    shared = staged(marks.mapInArrow(_meet_marks(HOT), "block bigint, mark bigint, hot boolean"), "marks")
    sent = lambda hot: texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send_entries(hot), _HOT_WINDOW if hot else _ENTRY)
    told = sent(False).repartition(tasks, "mark").sortWithinPartitions("mark").mapInArrow(_meet_entries, _TOLD)
    told = told.select("block", "at", "bits", F.lit(None).cast("boolean").alias("smaller"))
    if shared.where("hot").limit(1).count():
        windows = staged(sent(True), "windows", compression="zstd")
        low = windows.groupBy("data").agg(F.min("least").alias("low"))
        less = F.col("low") < F.col("least")
        told = told.unionByName(windows.join(low, "data").where(less | F.col("several")).select("block", "at", F.lit(0).cast("bigint").alias("bits"), less.alias("smaller")))
    told = staged(told, "told")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        of_window = right["smaller"].is_valid().to_numpy()
        at, bits = right["at"].to_numpy(), right["bits"].to_numpy()
        smaller = pa.compute.fill_null(right["smaller"], False).to_numpy()
        out = [empty]
        for blob in left["data"]:
            rows = _table(blob.as_py())
            e = entries(rows)
            out.append(pa.Table.from_batches([result(rows, e.offsets, _removed(e, at[~of_window], bits[~of_window], at[of_window], smaller[of_window]))]))
            del rows, e
        release()
        return pa.concat_tables(out)

    empty = _empty(schema)
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, schema)


def _empty(schema) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    return to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema)).empty_table()


def digests(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` (long) and ``kept_sha256`` of every row.

    Null texts are empty. Rows without an id neither lose bytes nor take any from others; rows with one
    id don't take from each other. Other columns are ignored.
    """

    def result(rows: pa.RecordBatch, offsets: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        before = np.append(0, np.cumsum(gone))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[firsts] = gone[firsts]
        spans = np.append(0, np.cumsum(opens))
        raw = pa.compute.fill_null(rows.column("text"), "").cast(pa.binary()).to_pylist()
        kept = []
        for t, a, b in zip(raw, offsets.tolist(), offsets[1:].tolist()):
            if before[b] > before[a]:
                t = np.frombuffer(t, np.uint8)[~gone[a:b]].tobytes()
            kept.append(sha256(t).hexdigest())
        columns = [rows.column("doc_id").cast(pa.int64()), np.diff(offsets), np.diff(before[offsets]), np.diff(spans[offsets]), kept]
        return pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _run(documents.select("doc_id", "text"), result, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``documents``, all columns and rows, with repeated passages cut out of ``text``.

    Same rules as :func:`digests`. A character of which only some bytes go, goes as a whole. A text that
    loses nothing stays as it is; one that loses all is empty.
    """

    def result(rows: pa.RecordBatch, offsets: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        before = np.append(0, np.cumsum(gone))
        text = rows.column("text").to_pylist()
        for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
            if before[b] > before[a]:
                text[i] = np.frombuffer(text[i].encode(), np.uint8)[~gone[a:b]].tobytes().decode("utf-8", "ignore")
        k = rows.schema.get_field_index("text")
        return rows.set_column(k, rows.schema.field(k), pa.array(text, rows.schema.field(k).type))

    return _run(documents, result, documents.schema)


#: :func:`digests` in DuckDB's SQL; it forms every window, so for small tables only.
SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, doc_id, s, hex(b[s:s + 49]) AS x FROM (SELECT rid, doc_id, b, unnest(range(1, octet_length(b) - 48)) AS s FROM d)),
r AS (SELECT rid, s FROM (SELECT rid, doc_id, s, min(doc_id) OVER (PARTITION BY x) AS m FROM w) WHERE m < doc_id),
g AS (SELECT rid, s, sum(fresh) OVER (PARTITION BY rid ORDER BY s ROWS UNBOUNDED PRECEDING) AS span
      FROM (SELECT rid, s, CASE WHEN s > lag(s, 1, -1000) OVER (PARTITION BY rid ORDER BY s) + 50 THEN 1 ELSE 0 END AS fresh FROM r)),
p AS (SELECT rid, span, min(s) AS a, max(s) + 50 AS e FROM g GROUP BY rid, span),
k AS (SELECT d.rid, p.a, lag(p.e, 1, 1) OVER (PARTITION BY d.rid ORDER BY p.a) AS f, hex(b) AS h FROM d JOIN p USING (rid)),
t AS (SELECT rid, string_agg(substr(h, 2 * f - 1, 2 * (a - f)), '' ORDER BY a) AS head, count(*) AS n_spans FROM k GROUP BY rid),
l AS (SELECT rid, max(e) AS e, sum(e - a) AS n_removed FROM p GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       CASE WHEN t.rid IS NULL THEN sha256(b) ELSE sha256(unhex(concat(head, substr(hex(b), 2 * l.e - 1)))) END AS kept_sha256
FROM d LEFT JOIN t USING (rid) LEFT JOIN l USING (rid)
"""
