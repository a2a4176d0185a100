"""Keyed boards that changelogs are applied to."""

from __future__ import annotations

import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators import changelog
from podium.schema import SUBMISSION_FILE


class BoardStore(Protocol):
    """Boards by name, members by id. Writing the same batch again must change nothing."""

    def apply(self, board: str, changes: DataFrame, batch: int) -> None: ...

    def read(self, board: str) -> DataFrame: ...

    def clear(self, board: str) -> None: ...


class ParquetTable:
    """Keyed tables of Parquet files: a base, and what each later batch changed.

    A batch writes its changes only; reading takes the last change of each key. Every COMPACT batches the changes are
    merged into a new base. A folder counts once it is complete, so a batch that broke off leaves nothing behind.
    For external stores, give a class with the same methods; none of their clients is imported here.
    """

    #: Batches of changes after which a new base is written.
    COMPACT = 16

    def __init__(self, spark: SparkSession, path: str, kind: str, key: str):
        self.spark, self.path, self.kind, self.key = spark, path.rstrip("/"), kind, key
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _folders(self, name: str) -> list[tuple[int, str, str]]:
        """(batch, kind, folder) of complete folders, in order; of one batch the base comes after the changes."""
        at = self._path(name)
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted((int(n.split("-")[0]), {"changes": "a", "base": "b"}[n.split("-")[1]], n) for n in names if self._fs.exists(self._path(name, n, "_SUCCESS")))

    def _live(self, name: str) -> tuple[str | None, list[str]]:
        """The last base, and the changes since."""
        have = self._folders(name)
        bases = [n for _, kind, n in have if kind == "b"]
        return (bases[-1] if bases else None), [n for b, kind, n in have if kind == "a" and (not bases or b > int(bases[-1].split("-")[0]))]

    def read(self, name: str) -> DataFrame:
        base, changes = self._live(name)
        files = lambda n: f"{self.path}/{name}/{n}"
        old = self.spark.read.schema(self.kind).parquet(files(base)) if base else self.spark.createDataFrame([], self.kind)
        if not changes:
            return old
        new = self.spark.read.schema(f"{self.kind}, _batch bigint, _gone boolean").parquet(*map(files, changes))
        columns = [c for c in old.columns if c != self.key]
        last = new.groupBy(self.key).agg(F.max_by(F.struct(*[F.col(c) for c in columns], "_gone"), "_batch").alias("_last"))
        kept = old.join(last.select(self.key), self.key, "left_anti")
        return kept.unionByName(last.where("NOT _last._gone").select(self.key, *[F.col(f"_last.{c}") for c in columns]))

    def done(self, name: str, batch: int) -> bool:
        """Whether a batch, or a later one, was written."""
        have = self._folders(name)
        return bool(have) and have[-1][0] >= batch

    def write(self, name: str, rows: DataFrame, gone: DataFrame | None, batch: int) -> None:
        """Replaces the ``rows``'s keys and removes the keys of ``gone``; a batch that was written is passed over."""
        if self.done(name, batch):
            return
        columns = self.spark.createDataFrame([], self.kind).columns
        marked = rows.select(*columns, F.lit(batch).cast("long").alias("_batch"), F.lit(False).alias("_gone"))
        if gone is not None:
            kinds = dict(self.spark.createDataFrame([], self.kind).dtypes)
            empty = [F.col(c) if c == self.key else F.lit(None).cast(kinds[c]).alias(c) for c in columns]
            marked = marked.unionByName(gone.select(*empty, F.lit(batch).cast("long").alias("_batch"), F.lit(True).alias("_gone")))
        marked.write.parquet(f"{self.path}/{name}/{batch:012d}-changes-{uuid.uuid4().hex}")
        if len(self._live(name)[1]) >= self.COMPACT:
            self.replace(name, self.read(name), batch)

    def replace(self, name: str, rows: DataFrame, batch: int) -> None:
        """Makes ``rows`` the whole table as of ``batch``."""
        before = self._folders(name)
        rows.write.parquet(f"{self.path}/{name}/{batch:012d}-base-{uuid.uuid4().hex}")
        bases = [i for i, (_, kind, _) in enumerate(before) if kind == "b"]
        for _, _, n in before[: bases[-1]] if bases else []:  # readers of the base before may still be at work
            self._fs.delete(self._path(name, n), True)

    def upsert(self, name: str, rows: DataFrame, batch: int) -> None:
        """Replaces the documents of the keys of ``rows``; of rows with one key any one, so make keys single."""
        self.write(name, rows, None, batch)

    def clear(self, name: str) -> None:
        have = self._folders(name)
        self.replace(name, self.read(name).limit(0), have[-1][0] + 1 if have else 0)


class ParquetBoards(ParquetTable):
    """Boards: ``id, score, lastUpdateTime``."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "id string, score double, lastUpdateTime bigint", "id")

    def apply(self, board: str, changes: DataFrame, batch: int) -> None:
        """Applies ``changes`` (seq, change_type, id, score, lastUpdateTime); a batch that was applied is passed over."""
        if self.done(board, batch):
            return
        last = changelog.last_changes(changes)
        new = last.where("change_type = 'INSERT'").select("id", "score", "lastUpdateTime")
        if changes.where("change_type = 'DELETEALL'").limit(1).count():
            self.replace(board, new, batch)
        else:
            self.write(board, new, last.where("change_type = 'DELETE'").select("id"), batch)


class ParquetDocuments(ParquetTable):
    """Whole submissions by uid, as a document store keeps them."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SUBMISSION_FILE), "uid")

    def upsert(self, name: str, rows: DataFrame, batch: int) -> None:
        """The last submission of each uid, by ``updatedAt``, replaces its document."""
        others = [c for c in SUBMISSION_FILE.names if c != "uid"]
        last = rows.where("uid IS NOT NULL").groupBy("uid").agg(F.max_by(F.struct(*others), "updatedAt").alias("_d"))
        self.write(name, last.select("uid", *[F.col(f"_d.{c}") for c in others]), None, batch)
