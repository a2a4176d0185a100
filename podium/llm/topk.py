"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Each block of candidates has one list for each dimension, in the order of the component. For a query
the lists are read step by step from the end that its own component prefers. What was read gives a lower bound of
a candidate's score, the places where reading stands an upper bound. Candidates whose upper bound is under the
k-th score reached so far are outsiders. Once few others are left, only these are followed further down the
lists, still step by step, until each is an outsider too or all of its components have been read.

Queries come in lots of bounded size, each lot broadcast to the blocks of candidates, which stay where they are. A lot
works through the blocks in rounds, each on many times more blocks than the one before: a round starts with the
k-th scores that the rounds before reached, so that few candidates of a task are worth sending on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import BLOB_ROWS, drop, scratch, ship, staged

#: Vectors in a block of candidates, and queries that are read side by side.
CANDIDATES, QUERIES = 4096, 512
#: Bytes of a broadcast lot of queries; blocks in the first round, and how many times more each next round has.
LOT, FIRST, GROWTH = 16 << 20, 4, 16
#: Steps in which a list is read; the part of the candidates below which only survivors are followed.
STEPS, FEW = 16, 1 / 32
#: Pairs of a query and a survivor that are followed side by side.
PAIRS = 1 << 14


def _matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of lists without nulls; shorter lists end in zeros."""
    sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    cols = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, cols] = np.floor(scale * flat)
    return out


def _pack(m: np.ndarray) -> tuple[int, bytes]:
    """(bytes of a number, data) in the smallest type that holds all numbers."""
    least, most = int(m.min(initial=0)), int(m.max(initial=0))
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
    return np.dtype(kind).itemsize, m.astype(kind).tobytes()


def _blocks(rows: DataFrame, size: int, scale: int, name: str) -> DataFrame:
    """``block, n, width, ids, bytes, data`` with up to ``size`` vectors to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                m = _matrix(part.column("vector"), scale)
                ids = part.column("id").to_numpy().astype(np.int64)
                wide, data = _pack(m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(ids)]), pa.array([m.shape[1]]), pa.array([ids.tobytes()], pa.binary()), pa.array([wide]), pa.array([data], pa.binary())],
                    names=["n", "width", "ids", "bytes", "data"],
                )

    got = rows.mapInArrow(run, "n bigint, width bigint, ids binary, bytes bigint, data binary").withColumn("block", F.monotonically_increasing_id())
    return staged(got, name, **(BLOB_ROWS | {"compression": "zstd"}))


def _open(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block, ``width`` components at least."""
    ids = np.frombuffer(row["ids"], np.int64)
    m = np.frombuffer(row["data"], f"<i{row['bytes']}").reshape(row["n"], row["width"]).astype(np.int64)
    return ids, np.pad(m, ((0, 0), (0, max(0, width - m.shape[1]))))


class Lists:
    """A block of candidates with each dimension's list."""

    def __init__(self, c: np.ndarray, dtype):
        self.c = c.astype(dtype)
        self.n, self.low, self.high = len(c), self.c.min(axis=0), self.c.max(axis=0)
        self.order = np.argsort(c, axis=0, kind="stable")  # ascending
        place = np.arange(self.n)[:, None]
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order, np.broadcast_to(place, self.order.shape), axis=0)

    def ends(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The components at which reading ``depth`` entries from the highest and from the lowest one stands."""
        every = np.arange(self.c.shape[1])
        return self.c[self.order[self.n - depth], every], self.c[self.order[depth - 1], every]

    def bounds(self, up: np.ndarray, down: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of all candidates for queries with positive parts ``up`` and negative parts ``down``
        after ``depth`` entries of each list: from the highest for ``up``, from the lowest for ``down``."""
        top, bottom = self.ends(depth)
        seen_top, seen_bottom = self.rank >= self.n - depth, self.rank < depth
        zero = self.c.dtype.type(0)
        both = np.concatenate([up, down], axis=1)
        upper = both @ np.concatenate([np.where(seen_top, self.c - top, zero), np.where(seen_bottom, self.c - bottom, zero)], axis=1).T
        upper += (up @ top + down @ bottom)[:, None]
        lower = both @ np.concatenate([np.where(seen_top, self.c - self.low, zero), np.where(seen_bottom, self.c - self.high, zero)], axis=1).T
        lower += (up @ self.low + down @ self.high)[:, None]
        return lower, upper

    def follow(self, q: np.ndarray, c: np.ndarray, row: np.ndarray, col: np.ndarray, depths: list[int], limit: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(pairs that stay, their scores): reads on for pairs of a query and a candidate, to one depth after the other.

        ``depths`` begins with the depth read already; ``c`` are the candidates as whole numbers, so sums are exact. A pair
        whose upper bound falls under its query's ``limit`` is left.
        """
        stay = np.arange(len(row))
        place = np.where(q[row] > 0, self.n - 1 - self.rank[col], self.rank[col])  # how deep in its list an entry comes
        gives = q[row] * c[col]
        total = np.where(place < depths[0], gives, 0).sum(axis=1)
        for done, depth in zip(depths, depths[1:]):
            total += np.where((place >= done) & (place < depth), gives, 0).sum(axis=1)
            if depth == self.n:
                break
            top, bottom = self.ends(depth)
            own = q[row[stay]]
            most = total + (np.where(place >= depth, np.where(own > 0, own * top, own * bottom), 0)).sum(axis=1)
            keep = most >= limit[row[stay]] - slack
            stay, place, gives, total = stay[keep], place[keep], gives[keep], total[keep]
        return stay, total


def _merged(ids: np.ndarray, scores: np.ndarray, rows: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each of n queries, ties to the smaller id; each query has k entries at least."""
    order = np.lexsort((ids, ~scores, rows))  # ~x falls as x rises
    rows = rows[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = order[place < k]
    return scores[keep].reshape(n, k), ids[keep].reshape(n, k)


NO_SCORE, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def search(
    query_ids: np.ndarray, q: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], k: int, floor: np.ndarray | None = None, read: list | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate's id, score): the k best candidates of each query, ties to the smaller id, in no order.

    Candidates under a query's ``floor`` may be left out. ``read`` is told of each block how many entries of
    the lists were read, and how many there are, over all queries.
    """
    floor = np.full(len(q), NO_SCORE) if floor is None else floor
    best_score, best_id = np.full((len(q), k), NO_SCORE), np.full((len(q), k), NO_ID)
    for ids, c in blocks:
        if not len(ids):
            continue
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1) * 2
        dtype = np.float32 if largest < 2**24 else np.float64
        slack = 0.0 if largest < 2**53 else largest * 2.0**-40  # bounds are rounded from there on, scores never
        lists = Lists(c, dtype)
        qd = q.astype(dtype)
        up, down = np.maximum(qd, 0), np.minimum(qd, 0)
        own = query_ids[:, None] == ids[None, :]
        depths = sorted({-(-lists.n * j // STEPS) for j in range(1, STEPS + 1)})
        reached = np.maximum(best_score[:, -1], floor)
        limit = np.where(reached == NO_SCORE, -np.inf, reached.astype(np.float64))
        for at, depth in enumerate(depths):
            if depth < lists.n:
                top, bottom = lists.ends(depth)
                # What no list has shown yet can't be told from an insider before its bound is under the limit.
                if np.mean(np.where(np.isinf(limit), 2 * depth >= lists.n, up @ top + down @ bottom <= limit)) < 0.5:
                    continue
            lower, upper = lists.bounds(up, down, depth)
            lower[own] = upper[own] = -np.inf  # a query's own rows take no place
            if lists.n > k:
                limit = np.maximum(limit, np.partition(lower, lists.n - k, axis=1)[:, lists.n - k] - slack)
            left = (upper >= limit[:, None] - slack) & ~own  # the others are outsiders
            if left.mean() <= FEW:
                break
        row, col = np.nonzero(left)
        pairs = [(z, *lists.follow(q, c, row[z], col[z], depths[at:] if depth < lists.n else [0, lists.n], limit, slack)) for a in range(0, len(row), PAIRS) for z in [slice(a, a + PAIRS)]]
        if read is not None:
            read.append((len(q) * depth * q.shape[1] + len(row) * (lists.n - depth) // lists.n * q.shape[1], len(q) * lists.n * q.shape[1]))
        if pairs:
            row, col, score = (np.concatenate(x) for x in zip(*((row[z][stay], col[z][stay], total) for z, stay, total in pairs)))
        else:
            score = np.zeros(0, np.int64)
        new = score >= reached[row]
        row, col, score = row[new], col[new], score[new]
        rows = np.concatenate([np.repeat(np.arange(len(q)), k), row])
        best_score, best_id = _merged(np.concatenate([best_id.ravel(), ids[col]]), np.concatenate([best_score.ravel(), score]), rows, len(q), k)
    real = best_id != NO_ID
    return np.broadcast_to(query_ids[:, None], real.shape)[real], best_id[real], best_score[real]


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _round(blocks: DataFrame, lot, floor, k: int) -> DataFrame:
    """The best candidates of each task's blocks for the queries of a lot (broadcast ids, vectors and floors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (query_ids, q), least = lot.value, floor.value
        held = [[np.zeros(0, np.int64)] * 3 for _ in range(0, len(q), QUERIES)]
        for batch in batches:
            for row in batch.to_pylist():
                ids, c = _open(row, q.shape[1])
                wide = np.pad(q, ((0, 0), (0, c.shape[1] - q.shape[1])))
                for i, a in enumerate(range(0, len(q), QUERIES)):
                    z = slice(a, a + QUERIES)
                    mine, other, score = held[i]
                    number = np.searchsorted(query_ids[z], mine)
                    low = least[z].copy()
                    have = np.bincount(number, minlength=len(low))
                    worst = np.full(len(low), NO_ID)
                    np.minimum.at(worst, number, score)
                    low = np.where(have >= k, np.maximum(low, worst), low)
                    found = search(query_ids[z], wide[z], iter([(ids, c)]), k, low)
                    mine, other, score = (np.concatenate(x) for x in zip(held[i], found))
                    order = np.lexsort((other, ~score, mine))
                    place = np.arange(len(order)) - np.searchsorted(mine[order], mine[order])
                    keep = order[place < k]
                    held[i] = [mine[keep], other[keep], score[keep]]
        for mine, other, score in held:
            yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(other), pa.array(score)], names=["query_id", "vec_id", "score"])

    return blocks.select("n", "width", "ids", "bytes", "data").mapInArrow(run, _FOUND)


def rounds(blocks: int, first: int, growth: int) -> list[tuple[float, float]]:
    """Parts of all blocks, as (from, to) between 0 and 1: about ``first`` blocks, then ``growth`` times more each time."""
    ends = []
    at = first
    while at * 2 < blocks:
        ends.append(at / blocks)
        at *= growth
    return list(zip([0.0, *ends], [*ends, 1.0]))


def top_k(embeddings: DataFrame, k: int = 20, scale: int = 64, every: int = 20, lot: int = LOT, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector whose id is divisible by ``every``, the ``k`` vectors of
    the highest inner product of floor(scale * x), all if there are fewer, ties to the smaller id.

    Scores have to fit a long. Rows with a null id or vector, or a null or non-finite component, take no part. Of
    vectors with one id, the smallest in the order of their components is the query, and none is a candidate for it; each is
    a candidate for the others, so repeated rows have as many places. Vectors of different lengths meet as if the
    shorter ended in zeros. Other columns are ignored. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    ship(spark)
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.where(v.isNotNull() & F.col("vec_id").isNotNull() & ~odd).select(F.col("vec_id").cast("long").alias("id"), v.cast("array<double>").alias("vector"))
    candidates = _blocks(rows, CANDIDATES, scale, "candidates")
    asked = staged(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    blocks, widest = candidates.agg(F.count("*"), F.max("width")).first()
    most = max(1, lot // (8 * max(widest or 0, 1)))  # queries of a lot
    lots = max(1, -(-2 * asked.count() // most))
    of_lot = lambda: F.pmod(F.xxhash64("id"), F.lit(lots).cast("long"))
    while lots > 1 and asked.groupBy(of_lot().alias("lot")).count().agg(F.max("count")).first()[0] > most:
        lots *= 2
    place = F.pmod(F.xxhash64("block"), F.lit(1 << 30).cast("long"))
    path = scratch(spark, "top")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for i in range(lots):
        got = asked.where(of_lot() == i).orderBy("id").toArrow()  # ``most`` rows at most
        ids, q = got["id"].to_numpy(), _matrix(got["vector"].combine_chunks(), scale)
        sent = spark.sparkContext.broadcast((ids, q))
        floor, best = np.full(len(ids), NO_SCORE), None
        parts = rounds(blocks, first, growth)
        for n, (low, high) in enumerate(parts):
            least = spark.sparkContext.broadcast(floor)
            some = candidates.where((place >= int(low * (1 << 30))) & (place < int(high * (1 << 30)) + (high == 1.0)))
            found = _round(some, sent, least, k)
            if best is not None:
                found = found.unionByName(best.drop("rank"))
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            if n + 1 == len(parts):
                found.select("query_id", "rank", "vec_id", "score").write.mode("overwrite").parquet(f"{path}/lot={i}")
            else:
                last, best = best, staged(found, "best")
                if last is not None:
                    drop(last)
                at = best.where(F.col("rank") == k).select("query_id", "score").toArrow()  # one row for each query of the lot
                floor = np.full(len(ids), NO_SCORE)
                floor[np.searchsorted(ids, at["query_id"].to_numpy())] = at["score"].to_numpy()
            least.unpersist()
        if best is not None:
            drop(best)
        sent.unpersist()
    drop(candidates, asked)
    return spark.read.schema("query_id bigint, rank int, vec_id bigint, score bigint, lot int").parquet(path).drop("lot")


#: The same in SQL; every pair is formed, so for small tables only.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
