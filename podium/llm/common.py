"""Helpers shared by the text operators: inputs, shared scratch tables, sizing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])
_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Let Python workers started on this machine import the package by its path."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths and _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a single-JVM local master may go without it; it then gets a temporary folder.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir()


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='podium-')}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, dropped at exit at the latest."""
    path = f"{shared_dir(spark)}/podium-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    return path


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage: a lost executor afterwards only costs a reread. :func:`drop` takes the table away, at the latest it
    goes at exit.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int, **options) -> DataFrame:
    """Like :func:`staged`, in ``buckets`` by a hash of ``key``: groups and joins by it then don't move the table's rows."""
    spark = df.sparkSession
    path = scratch(spark, name)
    known = f"podium_{uuid.uuid4().hex}"
    df.write.options(**options).bucketBy(buckets, key).option("path", path).saveAsTable(known)
    out = spark.table(known)
    out.staged_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables; only for tables that no later plan reads."""
    for t in tables:
        at = next((x for x in _written if x[1] == t.staged_at), None)
        if at is not None:
            _written.remove(at)
            drop_path(*at)


def _drop_all() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone; the shared folder's owner clears it
            return


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Options for staged tables whose rows are megabytes: small row groups, so that a scan can split them.
BLOB_ROWS = {
    "compression": "uncompressed",
    "parquet.block.size": str(8 << 20),
    "parquet.page.size.row.check.min": "1",
    "parquet.block.size.row.check.min": "1",
    "parquet.enable.dictionary": "false",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) only, whatever else the table carries."""
    return documents.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_mark():
    """The column that marks a row's text, a null one as the empty one."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def representatives(documents: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of ``documents`` for each root of ``rooted`` (``doc_id, mark, root``; :func:`text_mark`), all columns.

    The smallest id stands for a root, then the smallest mark; an id that stands for two roots by two texts has two
    rows. Rows without an id all stay.
    """
    rows = rooted.where("doc_id is not null").groupBy("root", "doc_id", "mark").count()
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "mark", "count")).alias("r"))
    keep = staged(first.select("r.doc_id", F.col("r.mark").alias("__mark"), "r.count"), "keep")
    marked = documents.withColumn("__mark", text_mark())
    on = ["doc_id", "__mark"]
    once = marked.join(keep.where("count = 1"), on, "left_semi")
    again = marked.join(keep.where("count > 1"), on, "left_semi").dropDuplicates(on)  # only repeated rows are dealt out
    return once.unionByName(again).select(documents.columns).unionByName(documents.where("doc_id is null"))


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of ``column`` each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def release() -> None:
    """Gives freed memory back to the system: workers stay for the next task, and others run beside them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def tasks_for(spark: SparkSession, total_bytes: int, each: int) -> int:
    """A number of shuffle partitions that grows with the data, never under the session's."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-int(total_bytes) // each))


def learning_rows(table: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """Rows that may be learnt from: crc32 of the id as text isn't ``held_out`` modulo ``modulus``."""
    return table.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % modulus != held_out))


def is_held_out(modulus: int, held_out: int):
    """The column that marks rows kept from learning; false for null ids."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held_out, F.lit(False))


def labelled(documents: DataFrame, labels: DataFrame, label: str, n: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``n`` labelled documents of each class 0 and 1, by a hash of the id.

    The ids of a bounded sample are broadcast; a repeated id counts once, by its smallest text. Null texts are empty.
    """
    marked = labels.where(f"{label} in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [marked.where(F.col("label") == v).orderBy(*order).limit(n) for v in (0, 1)]
    ids = some[0].unionByName(some[1])
    return texts(documents).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


#: Bytes that are gathered at a time: their places take sixteen times as much.
GATHERED = 1 << 19


def gather(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates slices of ``flat`` by their places and sizes, and where each starts in the result."""
    to = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=to[1:])
    out = np.empty(to[-1], flat.dtype)
    cuts = np.unique(np.append(np.searchsorted(to, np.arange(0, to[-1], GATHERED)), len(sizes)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        at = np.repeat(begin[a:b] - to[a:b], sizes[a:b])
        at += np.arange(to[a], to[b])
        out[to[a] : to[b]] = np.take(flat, at, mode="clip") if len(at) else 0
    return out, to


def same_as_before(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each slice of ``flat`` has the same content as the slice listed before it; never true for the first."""
    out = np.zeros(len(sizes), bool)
    if len(sizes) < 2:
        return out
    np.equal(sizes[1:], sizes[:-1], out=out[1:])
    of = np.flatnonzero(out)
    of = of[sizes[of] > 0]
    if len(of):
        x, to = gather(flat, begin[of], sizes[of])
        y, _ = gather(flat, begin[of - 1], sizes[of])
        out[of] = np.logical_and.reduceat(x == y, to[:-1])
    return out


def numbered(marks: np.ndarray, flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each slice of ``flat``; two slices have one number if and only if their content is equal.

    Equal slices must have equal ``marks``. Marks only bring slices together: content decides, and slices whose
    marks meet by chance (or by design) are told apart by a table of their contents.
    """
    order = np.argsort(marks, kind="stable")
    tied = np.zeros(len(marks), bool)
    np.equal(marks[order][1:], marks[order][:-1], out=tied[1:])
    same = np.zeros(len(marks), bool)
    of = np.flatnonzero(tied)
    if len(of):  # of neighbours under one mark, pairs side by side
        pairs = np.stack([order[of - 1], order[of]], axis=1).ravel()
        same[of] = same_as_before(flat, begin[pairs], sizes[pairs])[1::2]
    new = np.cumsum(~same) - 1
    out = np.empty(len(marks), np.int64)
    out[order] = new
    odd = np.flatnonzero(tied & ~same)
    if len(odd):  # different contents under one mark: equal ones may stand apart
        fresh, heads = int(new[-1]) + 1, np.cumsum(~tied) - 1
        for head in np.unique(heads[odd]).tolist():
            known: dict[bytes, int] = {}
            for i in order[np.searchsorted(heads, head) : np.searchsorted(heads, head, side="right")].tolist():
                out[i] = known.setdefault(flat[begin[i] : begin[i] + sizes[i]].tobytes(), fresh + len(known))
            fresh += len(known)
    return out


#: An odd number and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i up to ``n`` at least."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        p = np.full(max(n, 1 << 20) + 1, base, np.uint64)
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=np.uint64)
    return have
