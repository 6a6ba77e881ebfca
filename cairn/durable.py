"""Cutting lineage through shared storage.

Iterative operators must not carry an ever-growing plan, and must survive the loss of an
executor.  :class:`Workspace` writes intermediate tables as compressed Parquet below the folder the
cluster names in ``spark.checkpoint.dir``; only where that setting is absent (tests, a laptop) does
it make a folder of its own.  ``localCheckpoint`` is never used.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairn-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Workspace:
    """A private folder below the shared root holding the intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        self.spark = spark
        self.path = f"{shared_root(spark).rstrip('/')}/cairn/{purpose}-{uuid.uuid4().hex}"
        self._serial = 0
        self._paths: dict[int, str] = {}
        atexit.register(self._close)  # results may be read as long as the driver lives

    def _close(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone already
            self.drop(self.path)

    def location(self, name: str) -> str:
        """A fresh path inside the workspace."""
        self._serial += 1
        return f"{self.path}/{self._serial:04d}-{name}"

    def cut(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` once and return it as read back: same rows, no lineage."""
        path = self.save(df, name, partition_by)
        out = self.read(path, df)
        self._paths[id(out)] = path
        return out

    def release(self, df: DataFrame | None) -> None:
        """Remove the table behind a frame that :meth:`cut` returned and no later plan reads."""
        if path := self._paths.pop(id(df), None):
            self.drop(path)

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
        """Write ``df`` to a fresh path and return that path."""
        path = self.location(name)
        writer = df.write.mode("errorifexists").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return path

    def read(self, path: str, like: DataFrame) -> DataFrame:
        """Read a saved table with the schema of ``like`` (no inference job, empty tables included)."""
        return self.spark.read.schema(like.schema).parquet(path)

    def drop(self, path: str) -> None:
        """Remove one table of the workspace that no later plan reads."""
        files, where = _files(self.spark, path)
        files.delete(where, True)

    @staticmethod
    def mark(spark: SparkSession, path: str) -> None:
        """Write an empty marker file."""
        files, where = _files(spark, path)
        files.create(where, True).close()

    @staticmethod
    def names(spark: SparkSession, path: str) -> list[str]:
        """The names in a folder, none if it is absent."""
        files, where = _files(spark, path)
        return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path in its terms."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
