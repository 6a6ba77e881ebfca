"""Stored tables: content-addressed payloads, and copy-on-write snapshots behind a pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def object_key(namespace: str, sha: Column) -> Column:
    """Storage key ``namespace/<2 hex>/<sha256>.bin``."""
    return F.concat(F.lit(f"{namespace}/"), F.substring(sha, 1, 2), F.lit("/"), sha, F.lit(".bin"))


class ObjectStore:
    """Payloads by SHA-256 in one Parquet folder, partitioned by the first two hex digits.

    ``put`` is idempotent: payloads already there are left alone.  The look-up reads the keys of the
    touched partitions only.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _keys(self) -> DataFrame:
        _, where, fs = _fs(self.spark, self.root)
        if not fs.exists(where):
            return self.spark.createDataFrame([], "sha256 string, shard string")
        return self.spark.read.parquet(self.root).select("sha256", "shard")

    def put(self, payloads: DataFrame, content: str) -> DataFrame:
        """Store ``content`` (binary); returns ``(sha256, was_created)`` of its distinct payloads."""
        hashed = payloads.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("sha256"), F.col(content).alias("content"))
        new = hashed.groupBy("sha256").agg(F.first("content").alias("content")).withColumn("shard", F.substring("sha256", 1, 2))
        there = self._keys().withColumn("_there", F.lit(True))
        marked = new.join(there, ["sha256", "shard"], "left")
        from cairn.durable import Workspace

        result = Workspace(self.spark, "objects").cut(marked.select("sha256", F.col("_there").isNull().alias("was_created")), "put")
        fresh = new.join(result.where("was_created").select("sha256"), "sha256", "left_semi")
        fresh.repartition("shard").write.mode("append").partitionBy("shard").parquet(self.root)
        return result

    def delete(self, shas: DataFrame) -> DataFrame:
        """Delete payloads; returns ``(sha256, was_deleted)`` of those asked for.

        Only the shards that hold one of them are rewritten, each aside and then exchanged; their
        names, 256 at most, are what the driver sees.
        """
        from cairn.durable import Workspace

        asked = shas.where("sha256 is not null").select("sha256", F.substring("sha256", 1, 2).alias("shard")).distinct()
        there = self._keys().withColumn("_there", F.lit(True))
        space = Workspace(self.spark, "objects")
        told = space.cut(asked.join(there, ["sha256", "shard"], "left").select("sha256", "shard", F.col("_there").isNotNull().alias("was_deleted")), "delete")
        touched = [r[0] for r in told.where("was_deleted").select("shard").distinct().collect()]
        if touched:
            kept = self.spark.read.parquet(self.root).where(F.col("shard").isin(touched)).join(told.where("was_deleted").select("sha256", "shard"), ["sha256", "shard"], "left_anti")
            aside = space.location("kept")
            kept.repartition("shard").write.partitionBy("shard").parquet(aside)
            for shard in touched:
                _, old, fs = _fs(self.spark, f"{self.root}/shard={shard}")
                _, new, _ = _fs(self.spark, f"{aside}/shard={shard}")
                fs.delete(old, True)
                if fs.exists(new):
                    fs.rename(new, old)
        return told.select("sha256", "was_deleted")

    def get(self, shas: DataFrame) -> DataFrame:
        """``(sha256, content)`` of the wanted payloads."""
        wanted = shas.select("sha256", F.substring("sha256", 1, 2).alias("shard"))
        return self.spark.read.parquet(self.root).join(wanted, ["sha256", "shard"], "left_semi").select("sha256", "content")


class Snapshots:
    """A mutable table as immutable snapshots: a write makes a new folder and then moves the pointer.

    Readers keep the snapshot they opened; a failed write leaves the pointer where it was.  Pointers are
    numbered files, never replaced: the greatest counts, and a new one appears whole by a rename.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> list[int]:
        _, where, fs = _fs(self.spark, self.root)
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n.split("-")[1]) for n in names if n.startswith("CURRENT-"))

    def current(self) -> str | None:
        """The folder the pointer names."""
        numbers = self._pointers()
        if not numbers:
            return None
        _, where, fs = _fs(self.spark, f"{self.root}/CURRENT-{numbers[-1]:012d}")
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self) -> DataFrame:
        """The current rows."""
        return self.spark.read.parquet(self.current())

    def write(self, df: DataFrame) -> str:
        """Replace the rows."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        jvm, where, fs = _fs(self.spark, f"{self.root}/pending.{uuid.uuid4().hex}")
        stream = fs.create(where)
        stream.write(bytearray(path.encode()))
        stream.close()
        number = 1 + max(self._pointers(), default=0)
        if not fs.rename(where, jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT-{number:012d}")):
            raise RuntimeError(f"another write took number {number}")
        return path


def copy_table(source: DataFrame, url: str | None = None, name: str | None = None, path: str | None = None, partitions: int = 8, order: list[str] | None = None) -> None:
    """Copy rows to a relational table (``url`` and ``name``) or a Parquet folder (``path``).

    With ``order`` a folder's files hold the rows sorted, file after file.
    """
    if path:
        rows = source.repartitionByRange(partitions, *order).sortWithinPartitions(*order) if order else source
        rows.write.mode("overwrite").parquet(path)
    else:
        source.repartition(partitions).write.format("jdbc").options(url=url, dbtable=name, batchsize=10_000).mode("append").save()


def read_jdbc(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, partitions: int) -> DataFrame:
    """A relational table, read in parallel ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=partitions).load()
