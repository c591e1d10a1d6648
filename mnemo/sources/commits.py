"""Runs that are whole or not there: tables written under a run id, published by one marker.

A run writes any number of tables below its own folders, ``<root>/<table>/run=<id>``, and
then publishes itself by renaming one empty file into ``<root>/_commits``. Readers
list the markers and read the folders of those runs only, so a run that stopped at
any step has added nothing, and what it left behind is never read. Runs are numbered: a
run takes the number after the last it saw and claims it before it publishes, so of two
runs that began from the same state one is told to begin again. A root has one writer at a
time; the claim is there to notice when it has not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another run has been published since this one began."""


class RunLog:
    """The committed runs below ``root`` (a folder on shared storage)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        names = [x.getPath().getName() for x in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return sorted(n for n in names if not n.startswith("."))

    def committed(self) -> list[str]:
        """Ids of the published runs, oldest first."""
        return [n.split(".")[1] for n in self._names("_commits")]

    def read(self, table: str, schema: str) -> DataFrame:
        """The rows of a table of all published runs; none before the first."""
        held = set(self._names(table))
        paths = [f"{self.root}/{table}/run={r}" for r in self.committed() if f"run={r}" in held]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self) -> Run:
        return Run(self)


class Run:
    """One run: ``write`` its tables, then ``commit``. Without a commit nothing happened."""

    def __init__(self, log: RunLog):
        self.log = log
        self.seen = log.committed()
        taken = [int(n.split(".")[0]) for n in (*log._names("_claims"), *log._names("_commits"))]
        self.number = max(taken, default=0) + 1
        self.id = uuid.uuid4().hex

    def write(self, rows: DataFrame, table: str) -> None:
        rows.write.parquet(f"{self.log.root}/{table}/run={self.id}")

    def read(self, table: str, schema: str) -> DataFrame:
        """What this run has written of a table."""
        return self.log.spark.read.schema(schema).parquet(f"{self.log.root}/{table}/run={self.id}")

    def commit(self) -> None:
        fs, path, root = self.log._fs, self.log._path, self.log.root
        for folder in ("_claims", "_ready", "_commits"):
            fs.mkdirs(path(f"{root}/{folder}"))
        if not fs.createNewFile(path(f"{root}/_claims/{self.number:08d}")) or self.log.committed() != self.seen:
            raise Conflict(f"another run below {root} was published first")
        ready = path(f"{root}/_ready/{self.id}")
        fs.create(ready, False).close()
        if not fs.rename(ready, path(f"{root}/_commits/{self.number:08d}.{self.id}")):
            raise OSError(f"run {self.id} below {root} could not be published")
