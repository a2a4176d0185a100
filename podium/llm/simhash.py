"""SimHash near-duplicates: fingerprints, links by pivot distance tables, components.

Equal fingerprints are one class, so copies never pair up. Two fingerprints that differ in at most
r bits agree on one of r+1 blocks of bits at least (or on m-r of m blocks, for longer keys when there
are more classes): that decides which classes meet. Of those that meet, pairs are discarded by their
distances to reference fingerprints (the difference of two such distances is at most the distance
of the pair), and only survivors are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import chunks, representatives, ship, staged, tasks_for, text_mark, texts
from podium.llm.components import components, forest

#: Distances to the first SIFT of these are looked at in turn; seeded, so that every worker has the same.
PIVOTS = np.append(np.uint64(0), np.random.default_rng(64).integers(0, 1 << 63, 15, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
#: Classes that meet in one task at most; larger meetings are dealt out as pairs of parts.
MEETING = 4096


def fingerprint(words: list[bytes], width: int = 3, seed: int = 42) -> int:
    """Majority of each bit over the XXH64 of all word shingles, repeats included; no words: 0."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp long`` of every row: A-Z lower-cased, words split at ASCII white space; null texts are empty."""
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 4 << 20):
            raw = part.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t.lower().split(), width) for t in raw], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return texts(documents).mapInArrow(run, f"doc_id {kind}, fp bigint")


def keys(distance: int, classes: int) -> list[int]:
    """Masks of bits; fingerprints within ``distance`` agree under one of them at least.

    With m blocks each choice of m - distance is a mask. More blocks are taken as there are more
    classes, so that some hundred random ones meet at most; the result is exact for any m.
    """
    for m in range(distance + 1, 64):
        held = m - distance
        if classes >> (64 * held // m) <= 256 or held >= 6:
            break
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
    return [sum(c) for c in combinations(blocks, held)]


def _close(group: np.ndarray, fps: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within each group.

    Rows are sorted by group and first pivot distance; row i meets i+1, i+2, ... while the group is
    the same and the first coordinates differ by ``distance`` at most. ``side``: rows of the same
    side, if it is 0 or 1, were compared elsewhere.
    """
    far = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.lexsort((far[:, 0], group))
    group, fps, side, far = group[order], fps[order], side[order], far[order]
    at, lag = np.arange(len(fps) - 1), 1
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    held = 0
    while len(at):
        to = at + lag
        stay = (group[at] == group[to]) & (far[to, 0] - far[at, 0] <= distance)
        at, to = at[stay], to[stay]
        x, y = at, to
        apart = (side[x] != side[y]) | (side[x] == 2)
        x, y = x[apart], y[apart]
        for p in range(1, far.shape[1]):  # the largest coordinate difference, one coordinate at a time
            if not len(x):
                break
            near = np.abs(far[x, p] - far[y, p]) <= distance
            x, y = x[near], y[near]
        near = np.bitwise_count(fps[x] ^ fps[y]) <= distance
        if near.any():
            a.append(fps[x[near]].view(np.int64))
            b.append(fps[y[near]].view(np.int64))
            held += len(a[-1])
        if held > 1_000_000:  # keep a spanning forest only
            f = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [f[0]], [f[1]], 0
        lag += 1
        at = at[at + lag < len(fps)]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(a), np.concatenate(b))


def links(classes: DataFrame, distance: int = 3, count: int | None = None) -> DataFrame:
    """``a, b``: links between fingerprints of ``classes`` (column fp, distinct) that span the same
    components as all pairs within ``distance`` bits do.

    Null fingerprints link to nothing; no classes, no links. A link may come more than once.
    """
    spark = classes.sparkSession
    ship(spark)
    classes = classes.where("fp IS NOT NULL")
    n = classes.count() if count is None else count
    masks = keys(distance, n)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    met = classes.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("mask", "key")
    )
    big = met.groupBy("mask", "key").count().where(F.col("count") > MEETING).withColumn("parts", F.ceil(F.col("count") / MEETING))
    met = met.join(big.drop("count"), ["mask", "key"], "left")
    # A meeting in p parts goes to each pair of parts: a row goes to all p pairs that have its part.
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    met = met.withColumn("own", part).select(
        "fp",
        "mask",
        "key",
        "own",
        F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))).alias("other"),
    )
    low, high = F.least("own", "other"), F.greatest("own", "other")
    whole = (F.col("other") == -1) | (F.col("own") == F.col("other"))
    met = met.select(
        "fp",
        F.xxhash64("mask", "key", F.when(F.col("other") == -1, -1).otherwise(low), F.when(F.col("other") == -1, -1).otherwise(high)).alias("meeting"),
        F.when(whole, 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("byte").alias("side"),
    )
    tasks = tasks_for(spark, n * len(masks) * 24, 8 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        a, b = _close(
            t["meeting"].to_numpy(), t["fp"].to_numpy().view(np.uint64), t["side"].to_numpy(), distance
        )
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return met.repartition(tasks, "meeting").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """``doc_id, fingerprint string, component_id`` of every row.

    ``component_id`` is the smallest ``doc_id`` that can be reached over links of at most ``distance``
    differing bits, the row's own included. Null and wordless texts have fingerprint zero and link like
    any other. Null ids are smallest nowhere; a component of null ids only has a null id. Repeated
    rows stay. Other columns are ignored.
    """
    of_docs = staged(fingerprints(documents, width), "fingerprints")
    classes = staged(of_docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), distance))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return of_docs.join(of_class, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(documents: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """The rows of ``documents`` that stand for their component, all columns; one row for each.

    Rows without an id can't be told apart and all stay.
    """
    # An id may have several texts: rows go by id and text here, and so do their components.
    name = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", text_mark().alias("mark")))
    found = near_duplicates(documents.select(name.alias("doc_id"), "text"), distance, width)
    return representatives(documents, found.select("doc_id.doc_id", "doc_id.mark", F.col("component_id").alias("root")))
