"""Near copies by exact Jaccard similarity of word shingles: links by SimHash first, then by shared prefixes; components.

Texts with equal sets of shingles are one class. Classes whose SimHash fingerprints are linked are compared set by set first,
which joins most copies. Fingerprints alone would miss pairs: at a similarity of 0.8 some ten of 64 bits differ, and no key that
few enough fingerprints share reaches so far. So an exact way handles the rest. Each class sorts its shingles in one order for all, frequent
ones last. Two sets of similarity s share a shingle among the first n - ceil(s n) + 1 of each: these
prefixes decide which classes meet. The places of the shared shingle bound the overlap from above, the parities
of the sets' parts the difference from below. What is left is compared set by set. The sample that names
frequent shingles only decides on the order, so no pair is missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import chunks, release, representatives, ship, staged, tasks_for, text_mark, texts
from podium.llm.components import components
from podium.llm.simhash import fingerprint, links

#: Words of a shingle, and the least similarity of near copies in per cent.
WIDTH, PERCENT = 5, 80
#: Classes that meet in one task at most; larger meetings are dealt out as pairs of parts.
MEETING = 4096
#: Frequent shingles named at most, and in how many texts of the sample they are at least.
FREQUENT, OFTEN = 1 << 16, 4
#: In the first round a class is compared with the ones so many places after it.
LAGS = (1, 2, 4)
#: Pairs looked at side by side.
TOGETHER = 1 << 17
#: Parts of a set whose parities are kept, a multiple of 64.
PARITIES = 512


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of the distinct word shingles, ascending; words as in :func:`simhash.fingerprints`."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, parts, repeat(42)), np.uint64))


def _key(s: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(s.tobytes())


def frequent(documents: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, ascending, and their place from rare to common."""
    some = max(1, min(64, documents.count() // 8192))
    sample = texts(documents).select("text", text_mark().alias("mark")).where(F.pmod("mark", F.lit(some).cast("long")) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 4 << 20):
            for mark, t in zip(part.column("mark").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                s = shingles(t, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), mark))], names=["s", "mark"])

    rows = sample.mapInArrow(run, "s bigint, mark bigint").distinct().groupBy("s").count().where(F.col("count") >= OFTEN)
    got = [r["s"] for r in rows.orderBy(F.desc("count"), "s").limit(FREQUENT).select("s").collect()]
    s = np.array(got[::-1], np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], order + 1


def parities(s: np.ndarray) -> bytes:
    """Whether each part has an odd number of shingles; sets differ by as many shingles at least as in parities."""
    return np.packbits((np.bincount((s % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).astype(bool)).tobytes()


def _prefix(s: np.ndarray, often: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    if len(often):
        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
        s = s[np.argsort(np.where(often[at] == s, place[at], 0), kind="stable")]
    return s[: len(s) + (-percent * len(s) // 100) + 1] if len(s) else s


def _described(documents: DataFrame, percent: int, width: int) -> DataFrame:
    """``row, doc_id, mark, key, n, odd, fp, prefix`` of every row: its number, marks of the text and of the set, the set's size,
    parities, fingerprint and prefix."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    often, place = frequent(documents, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 4 << 20):
            raw = part.column("text").cast(pa.binary()).to_pylist()
            sets = [shingles(t, width) for t in raw]
            fps = np.array([fingerprint(t.lower().split(), width) for t in raw], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("mark"),
                    pa.array([_key(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([parities(s) for s in sets], pa.binary()),
                    pa.array(fps.view(np.int64)),
                    pa.array([_prefix(s, often, place, percent).view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "mark", "key", "n", "odd", "fp", "prefix"],
            )
        release()

    rows = texts(documents).select("doc_id", "text", text_mark().alias("mark"))
    got = rows.mapInArrow(run, f"doc_id {kind}, mark bigint, key binary, n bigint, odd binary, fp bigint, prefix array<bigint>")
    return got.withColumn("row", F.monotonically_increasing_id())


def _possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, p: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and places allow sets to be similar, if this is the first shingle they share."""
    most = np.minimum(n[x] - p[x], n[y] - p[y])
    return (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & ((100 + percent) * most >= percent * (n[x] + n[y]))


def _meetings(of_docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``meeting, side, c, n, odd, p``: classes with a shingle of their prefixes in common, and its place in them."""
    rows = of_docs.join(classes.select(F.col("c").alias("row")), "row", "left_semi")
    many = of_docs.agg(F.sum(F.size("prefix"))).first()[0] or 0
    met = rows.select("row", "n", F.posexplode("prefix").alias("p", "s")).select(F.col("row").alias("c"), "s", F.shiftleft("n", 24).bitwiseOR(F.least("p", F.lit((1 << 24) - 1))).alias("np"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        s, c, both = (t[x].to_numpy() for x in ("s", "c", "np"))
        order = np.lexsort((both, s))  # by size within a shingle
        s, c, n, p = s[order], c[order], both[order] >> 24, both[order] & ((1 << 24) - 1)
        start = np.append(0, np.flatnonzero(np.diff(s)) + 1)
        count = np.diff(np.append(start, len(s)))
        keep = count > 1
        two = start[count == 2]
        keep[count == 2] = _possible(two, two + 1, n, p, percent)
        keep, count = np.repeat(keep, count), np.repeat(count, count)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (s, c, p, count)], names=["s", "c", "p", "count"])
        release()

    tasks = tasks_for(classes.sparkSession, many * 24, 16 << 20)
    met = met.repartition(tasks, "s").mapInArrow(run, "s bigint, c bigint, p bigint, count bigint").join(classes.select("c", "n", "odd"), "c")
    parts = F.when(F.col("count") > MEETING, F.ceil(F.col("count") / MEETING))
    met = met.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("c"), F.col("parts")))
    # A meeting in p parts goes to each pair of parts: a row goes to all p pairs that have its part.
    every = F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    met = met.select("*", F.explode(every).alias("other"))
    own = F.coalesce("own", F.lit(-1).cast("long"))
    side = F.when(own == F.col("other"), 2).when(own < F.col("other"), 0).otherwise(1).cast("byte")
    meeting = F.xxhash64("s", F.least(own, "other"), F.greatest(own, "other"))
    return met.select(meeting.alias("meeting"), side.alias("side"), "c", "n", "odd", "p")


def _pairs(rows: pa.Table, first: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that meet, can be similar and have different roots: all of them, or if ``first`` those of
    neighbours by size and those with the one of each meeting whose shared shingle stands first."""
    meeting, side, c, n, p, root = (rows[x].to_numpy() for x in ("meeting", "side", "c", "n", "p", "root"))
    odd = np.frombuffer(b"".join(rows["odd"].to_pylist()), np.uint64).reshape(len(c), -1)

    def left(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = (meeting[x] == meeting[y]) & (root[x] != root[y]) & ((side[x] != side[y]) | (side[x] == 2))
        x, y = x[ok], y[ok]
        ok = _possible(x, y, n, p, percent)
        x, y = x[ok], y[ok]
        ok = (100 + percent) * np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64) <= (100 - percent) * (n[x] + n[y])
        x, y = c[x[ok]], c[y[ok]]
        return np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)

    def ends(change: np.ndarray) -> np.ndarray:
        """The end of the run that each place lies in."""
        at = np.append(np.flatnonzero(change) + 1, len(c))
        return at[np.searchsorted(at, np.arange(len(c)), side="right")]

    out = [np.zeros((0, 2), np.int64)]
    if first:
        order = np.lexsort((c, n, meeting))
        out += [left(x, y) for lag in LAGS for x, y in _together(order[:-lag], order[lag:])]
        order = np.lexsort((c, p, meeting))
        start = np.searchsorted(meeting[order], meeting[order])
        out += [left(x, y) for x, y in _together(order[start], order)]
    else:
        order = np.lexsort((c, n, root, meeting))
        m = np.diff(meeting[order]) != 0
        start = ends(m | (np.diff(root[order]) != 0))  # rows of one root stand together
        many = ends(m) - start
        done = np.cumsum(many)
        k = 0
        while k < len(order):
            to = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + TOGETHER, side="right")))
            own = many[k:to]
            x = np.repeat(np.arange(k, to), own)
            y = np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(start[k:to], own)
            out.append(left(order[x], order[y]))
            k = to
    pairs = np.unique(np.concatenate(out), axis=0)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _together(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(0, len(x), TOGETHER):
        yield x[k : k + TOGETHER], y[k : k + TOGETHER]


def _candidates(met: DataFrame, tasks: int, roots: DataFrame | None, percent: int) -> DataFrame:
    first = roots is None
    if first:
        rows = met.withColumn("root", F.col("c"))
    else:
        rows = met.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        a, b = _pairs(pa.Table.from_batches(got), first, percent)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = rows.select("meeting", "side", "c", "n", "odd", "p", "root")
    return rows.repartition(tasks, "meeting").mapInArrow(run, "a bigint, b bigint").distinct()


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """``a, b``: pairs of classes to look at, by links between their fingerprints; classes of one fingerprint go with its first."""
    first = staged(classes.groupBy("fp").agg(F.min("c").alias("first")), "fingerprints")
    found = links(first.select("fp"))
    side = lambda name: first.select(F.col("fp").alias(name), F.col("first").alias(f"{name}_c"))
    linked = found.join(side("a"), "a").join(side("b"), "b").select(F.least("a_c", "b_c").alias("a"), F.greatest("a_c", "b_c").alias("b"))
    alike = classes.join(first, "fp").where("c <> first").select(F.col("first").alias("a"), F.col("c").alias("b"))
    return linked.unionByName(alike).distinct()


def _similar(pairs: DataFrame, classes: DataFrame, documents: DataFrame, percent: int, width: int) -> DataFrame:
    """Those of ``pairs`` whose sets are similar. Words travel compressed, as they are smaller than sets."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 4 << 20):
            raw = part.column("text").cast(pa.binary()).to_pylist()
            keys = [_key(shingles(t, width)) for t in raw]
            words = [zlib.compress(b" ".join(t.lower().split())) for t in raw]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(words, pa.binary())], names=["key", "words"])
        release()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (shingles(zlib.decompress(z.as_buffer()), width) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        release()

    nodes = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    wanted = staged(classes.join(nodes, "c").select("c", "key", "mark"), "wanted")
    rows = texts(documents).select("text", text_mark().alias("mark")).join(wanted.select("mark"), "mark", "left_semi")
    sets = rows.select("text").mapInArrow(build, "key binary, words binary").join(wanted, "key").select("c", "words")
    sets = staged(sets.dropDuplicates(["c"]), "sets")
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("words").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("words").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def rooted(documents: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``doc_id, mark, root`` of every row; two rows have one root if near copies lead from one to the other.

    Near copies share at least ``percent`` % of their distinct shingles of ``width`` words together. A text of fewer words
    is one shingle; texts without words are copies of each other. Null ids link like any other.
    """
    spark = documents.sparkSession
    ship(spark)
    of_docs = staged(_described(documents, percent, width), "described")
    # A class goes by the number of its first row.
    classes = staged(of_docs.groupBy("key").agg(F.min("row").alias("c"), F.min("mark").alias("mark"), F.max("n").alias("n"), F.min("odd").alias("odd"), F.min("fp").alias("fp")), "classes")
    met = staged(_meetings(of_docs, classes, percent), "met")
    tasks = tasks_for(spark, met.count() * 112, 8 << 20)
    # Linked fingerprints and neighbours first, so that a large group is mostly one component before all other pairs are formed.
    some = _by_fingerprint(classes).unionByName(_candidates(met, tasks, None, percent)).distinct()
    near = staged(_similar(staged(some, "pairs"), classes, documents, percent, width), "similar")
    others = staged(_candidates(met, tasks, components(near), percent), "pairs")
    links = near.unionByName(_similar(others, classes, documents, percent, width))
    roots = components(links).withColumnRenamed("node", "c")
    of_class = classes.select("key", "c").join(roots, "c", "left").select("key", F.coalesce("root", "c").alias("root"))
    return of_docs.join(of_class, "key").select("doc_id", "mark", "root")


def deduplicate(documents: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row of each component of near copies, all columns: the one with the smallest id.

    Rows without an id can't be told apart and all stay.
    """
    return representatives(documents, rooted(documents, percent, width))
