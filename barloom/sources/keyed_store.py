"""Tables that micro-batches write to shared folders, so that a repeated batch changes nothing and reads stay bounded.

A ``KeyedStore`` holds revisions of keyed rows. Every micro-batch overwrites a folder of its own; after ``every`` of
them the newest row of each key is merged with the last generation into a new one. A pointer, an empty file
whose name holds the generation and the last batch in it, makes the new generation visible at once; a reader that had begun
still finds the old generation and its revisions, which go when the generation after next is written. So a reader
finds one generation and fewer than ``every`` folders, however many batches there were.

A ``Snapshots`` table is replaced as a whole by every micro-batch; the two newest states are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Folder:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._place(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def names(self, below: str = "") -> list[str]:
        place = self._place(f"{self.path}/{below}" if below else self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def mark(self, name: str) -> None:
        """Create an empty file; it is there as a whole or not at all."""
        place = self._place(f"{self.path}/{name}")
        if not self._fs.exists(place):
            self._fs.create(place, False).close()

    def drop(self, name: str) -> None:
        self._fs.delete(self._place(f"{self.path}/{name}"), True)

    def numbers(self, below: str, prefix: str) -> list[int]:
        """The numbers of written folders; one without its mark of success is not there yet."""
        found = (n for n in self.names(below) if n.startswith(prefix))
        return sorted(int(n.removeprefix(prefix)) for n in found if "_SUCCESS" in self.names(f"{below}/{n}"))


class KeyedStore:
    """The newest revision of every key. ``keys`` may be left out where rows are only written and never merged.

    Batch numbers come from one stream and its checkpoint; a new checkpoint needs a new store.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), every: int = 16):
        self.spark, self.path, self.keys, self.every = spark, path, list(keys), every
        self.folder = Folder(spark, path)

    def pointers(self) -> list[tuple[int, int]]:
        """(generation, last batch in it), oldest first."""
        return sorted(tuple(int(x) for x in n.split("-")) for n in self.folder.names("pointers") if not n.startswith("."))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Store a micro-batch, once. A batch that a generation already holds is not written again."""
        if batch_id <= self._newest()[1]:
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/revisions/batch={batch_id}")
        if self.keys and self.every and len(self._open()) >= self.every:
            self.compact()

    def _newest(self) -> tuple[int, int]:
        found = self.pointers()
        return found[-1] if found else (-1, -1)

    def _open(self) -> list[int]:
        """The batches that no generation holds yet."""
        upto = self._newest()[1]
        return [b for b in self.folder.numbers("revisions", "batch=") if b > upto]

    def parts(self) -> list[str]:
        """The folders that a reader needs now."""
        generation, _ = self._newest()
        base = [f"{self.path}/generations/generation={generation}"] if generation >= 0 else []
        return base + [f"{self.path}/revisions/batch={b}" for b in self._open()]

    def revisions(self) -> DataFrame | None:
        """All rows that count, with the batch of each in ``_batch``; None where nothing was written yet."""
        generation, _ = self._newest()
        out = None
        if generation >= 0:
            out = self.spark.read.parquet(f"{self.path}/generations/generation={generation}")
        if batches := self._open():
            read = self.spark.read.option("basePath", f"{self.path}/revisions")
            new = read.parquet(*(f"{self.path}/revisions/batch={b}" for b in batches))
            new = new.withColumn("_batch", F.col("batch").cast("long")).drop("batch")
            out = new if out is None else out.unionByName(new, allowMissingColumns=True)
        return out

    def read(self) -> DataFrame | None:
        """The newest row of every key."""
        rows = self._latest()
        return None if rows is None else rows.drop("_batch")

    def _latest(self) -> DataFrame | None:
        rows = self.revisions()
        if rows is None:
            return None
        w = Window.partitionBy(*self.keys).orderBy(F.desc("_batch"))
        return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")

    def compact(self) -> None:
        """Merge what is there into a new generation, show it, and drop what the one before last left.

        Broken off at any point it changes nothing: the generation is written anew by the next call.
        """
        batches, before = self._open(), self.pointers()
        if not batches:
            return
        generation = before[-1][0] + 1 if before else 0
        self._latest().write.mode("overwrite").parquet(f"{self.path}/generations/generation={generation}")
        self.folder.mark(f"pointers/{generation}-{batches[-1]}")
        for old, upto in before[:-1]:
            self.folder.drop(f"generations/generation={old}")
            self.folder.drop(f"pointers/{old}-{upto}")
        if before:
            for b in self.folder.numbers("revisions", "batch="):
                if b <= before[-1][1]:
                    self.folder.drop(f"revisions/batch={b}")


class Snapshots:
    """A table that every micro-batch replaces."""

    def __init__(self, spark: SparkSession, path: str, kept: int = 2):
        self.spark, self.path, self.kept = spark, path, kept
        self.folder = Folder(spark, path)

    def before(self, batch_id: int, schema: str) -> DataFrame:
        """The table as the newest batch before this one left it, empty where there is none."""
        found = [b for b in self.folder.numbers("", "batch=") if b < batch_id]
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/batch={found[-1]}")

    def read(self) -> DataFrame | None:
        found = self.folder.numbers("", "batch=")
        return self.spark.read.parquet(f"{self.path}/batch={found[-1]}") if found else None

    def write(self, table: DataFrame, batch_id: int) -> None:
        """Store the table; the batch before stays, so that this one can be repeated."""
        table.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        for b in self.folder.numbers("", "batch=")[: -self.kept]:
            self.folder.drop(f"batch={b}")
