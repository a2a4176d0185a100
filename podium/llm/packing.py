"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Pieces are dealt to shards by a hash of their row's number, so that equal ones don't meet and every shard has a random choice of lengths. Each shard is one packing
problem, on which several islands work. A chromosome is a list of sequences; crossover injects whole
well-filled sequences of one parent into the other, takes away the sequences there that hold a piece twice, and
best-fits the pieces these leave without a place. After each epoch an island's best chromosome moves to the next
island. A shard ends when it has as few sequences as its tokens need at least, or with the last epoch.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import chunks, release, ship, staged, texts

#: Pieces in a shard, islands of a shard, epochs, generations of an epoch, chromosomes of an island.
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 8192, 3, 3, 12, 6

Bins = list[list[int]]


def pieces(documents: DataFrame, ranks: str, length: int = 2048, special: tuple[tuple[str, int], ...] = (), end: int = 0, ids: bool = False) -> DataFrame:
    """``doc_id, piece int, start long, length long, ids_crc32 long`` and, if asked for, ``ids array<int>``.

    A document's ids are its text's and ``end``. Only longer ones than ``length`` are cut, from the end, so
    that the first piece is the short one. Null texts are empty and have one piece of one id.
    """
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        from podium.llm.bpe import CHUNK, codec

        c = codec(ranks, special)
        for part in chunks(batches, "text", CHUNK):
            row, piece, start, size, crc, own = [], [], [], [], [], []
            for i, got in enumerate(c.encode(part.column("text").to_pylist())):
                all_ids = np.append(got, end).astype("<u4")
                first = len(all_ids) % length or length
                at = 0
                for k, to in enumerate(range(min(first, len(all_ids)), len(all_ids) + 1, length)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(to - at)
                    crc.append(crc32(all_ids[at:to].data))
                    if ids:
                        own.append(all_ids[at:to].astype(np.int32))
                    at = to
            columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            columns += [pa.array(own, pa.list_(pa.int32()))] * ids
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])
        release()

    return texts(documents).mapInArrow(run, schema)


def best_fit(items: list[int], size: list[int], bins: Bins, capacity: int) -> Bins:
    """Puts each item, in the order given, into the bin that it fills best; opens bins as needed."""
    fill = [sum(size[i] for i in b) for b in bins]
    room = sorted((capacity - f, k) for k, f in enumerate(fill) if f < capacity)
    for i in items:
        at = bisect_left(room, (size[i], -1))
        if at == len(room):
            bins.append([i])
            if size[i] < capacity:
                insort(room, (capacity - size[i], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            if left > size[i]:
                insort(room, (left - size[i], k))
    return bins


def fitness(bins: Bins, size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller full ones; smaller is better."""
    return len(bins), -sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins)


def cross(a: Bins, b: Bins, size: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """``a`` with some well-filled bins of ``b`` injected whole."""
    full = [x for x in b if sum(size[i] for i in x) >= 0.99 * capacity]
    if not full:
        full = b
    n = int(rng.integers(1, max(2, len(full) // 2 + 1)))
    injected = [full[k] for k in rng.choice(len(full), min(n, len(full)), replace=False)]
    taken = {i for x in injected for i in x}
    kept, displaced = [list(x) for x in injected], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    displaced.sort(key=size.__getitem__, reverse=True)
    return best_fit(displaced, size, kept, capacity)


def mutate(a: Bins, size: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """``a`` with its emptiest bins and a few others dissolved and their items best-fitted."""
    order = sorted(range(len(a)), key=lambda k: sum(size[i] for i in a[k]))
    gone = {*order[: max(1, len(a) // 50)], *rng.choice(len(a), min(len(a), 3), replace=False).tolist()}
    items = [i for k in gone for i in a[k]]
    items.sort(key=lambda i: size[i] * rng.uniform(0.9, 1.1), reverse=True)
    return best_fit(items, size, [list(x) for k, x in enumerate(a) if k not in gone], capacity)


def evolve(size: list[int], population: list[Bins], capacity: int, seed: int, generations: int = GENERATIONS) -> list[Bins]:
    """The population after some generations, the best first; stops at the least number of bins there can be."""
    rng = np.random.default_rng(seed)
    need = -(-sum(size) // capacity)
    order = sorted(range(len(size)), key=size.__getitem__, reverse=True)
    if not population:
        population = [best_fit(order, size, [], capacity)]
    score = [fitness(p, size, capacity) for p in population]
    while len(population) < POPULATION and min(score)[0] > need:
        noise = rng.uniform(0.8, 1.25, len(size))
        population.append(best_fit(sorted(order, key=lambda i: size[i] * noise[i], reverse=True), size, [], capacity))
        score.append(fitness(population[-1], size, capacity))
    for _ in range(generations):
        if min(score)[0] <= need or len(population) < 2:
            break
        x, y = (min(rng.choice(len(population), 2, replace=False), key=score.__getitem__) for _ in range(2))
        child = cross(population[x], population[y], size, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, size, capacity, rng)
        worst = max(range(len(score)), key=score.__getitem__)
        own = fitness(child, size, capacity)
        if own < score[worst]:
            population[worst], score[worst] = child, own
    return [population[k] for k in sorted(range(len(population)), key=score.__getitem__)]


def _as_array(bins: Bins, n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _as_bins(a: np.ndarray) -> Bins:
    out: Bins = [[] for _ in range(int(a.max()) + 1 if len(a) else 0)]
    for i, k in enumerate(a.tolist()):
        out[k].append(i)
    return out


_ISLAND = "shard bigint, island int, sizes binary, chromosomes array<binary>, bins int, need int"


def _island_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["shard", "island", "sizes", "chromosomes", "bins", "need"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=names)


def _epoch(capacity: int, epoch: int):
    """One epoch on every island; the islands of a shard that has ended stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, island, sizes, chromosomes, bins, need in zip(*(c.to_pylist() for c in batch.columns)):
                if chromosomes is None or bins is None or bins > need:
                    size = np.frombuffer(sizes, np.int32).tolist()
                    population = [_as_bins(np.frombuffer(c, np.int32)) for c in chromosomes or []]
                    population = evolve(size, population, capacity, seed=hash((shard, island, epoch)) & 0xFFFFFFFF)
                    bins, need = len(population[0]), -(-sum(size) // capacity)
                    chromosomes = [_as_array(p, len(size)).tobytes() for p in population]
                yield _island_rows([(shard, island, sizes, chromosomes, bins, need)])
        release()

    return run


def pack(found: DataFrame, capacity: int = 2048, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``found`` (pieces with a ``length`` of at most ``capacity``; all their columns) with ``sequence_id, offset``.

    Every piece has a place, repeated rows too; in a sequence, offsets leave no gap. Nothing is gathered
    beyond a shard, whose number of pieces doesn't grow with the data.
    """
    spark = found.sparkSession
    ship(spark)
    columns = found.columns
    at = "__at"
    while at in columns:
        at += "_"
    # The number of a row in the written table deals equal rows out too, and never changes once it is written.
    rows = staged(found.withColumn(at, F.monotonically_increasing_id()), "pieces")
    n = rows.count()
    shards = max(1, -(-n // shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(at), F.lit(shards).cast("long")))

    def problem(group: pa.Table) -> pa.Table:
        size = _sizes(_ordered(group, at), capacity)
        return pa.Table.from_batches([_island_rows([(group["shard"][0].as_py(), k, size.astype(np.int32).tobytes(), None, None, None) for k in range(islands)])])

    state = staged(dealt.groupBy("shard").applyInArrow(problem, _ISLAND).repartition(max(1, min(shards * islands, 4096)), "shard", "island").mapInArrow(_epoch(capacity, 0), _ISLAND), "islands")
    for epoch in range(1, epochs):
        if not state.where("bins > need").limit(1).count():
            break
        best = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("chromosomes")[0].alias("came"))
        moved = state.join(best, ["shard", "island"]).select(
            "shard", "island", "sizes", F.slice(F.concat(F.array("came"), "chromosomes"), 1, POPULATION).alias("chromosomes"), "bins", "need"
        )
        state = staged(moved.mapInArrow(_epoch(capacity, epoch), _ISLAND), "islands")
    winner = state.groupBy("shard").agg(F.min_by(F.col("chromosomes")[0], F.struct("bins", "island")).alias("best"))

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        group = _ordered(left, at)
        size = group["length"].to_numpy()
        whole = size >= capacity
        bins = np.zeros(len(size), np.int64)
        own = np.frombuffer(right["best"][0].as_py(), np.int32)
        bins[~whole] = own
        bins[whole] = (int(own.max()) + 1 if len(own) else 0) + np.arange(int(whole.sum()))
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        new = np.append(True, np.diff(bins[order]) != 0)
        offset = np.zeros(len(size), np.int64)
        offset[order] = before - before[np.flatnonzero(new)][np.cumsum(new) - 1]
        number = (np.int64(left["shard"][0].as_py()) << 32) + bins
        return group.select(columns).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return dealt.groupBy("shard").cogroup(winner.groupBy("shard")).applyInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def _ordered(group: pa.Table, at: str) -> pa.Table:
    """A shard's rows in an order that doesn't depend on how they came; rows without an id last, equal rows by their numbers."""
    by = [c for c in ("doc_id", "piece", "start", "length", "ids_crc32", at) if c in group.column_names]
    return group.take(pa.compute.sort_indices(group, [(c, "ascending") for c in by]))


def _sizes(group: pa.Table, capacity: int) -> np.ndarray:
    """Lengths of the pieces that share a sequence."""
    size = group["length"].to_numpy()
    return size[size < capacity]
