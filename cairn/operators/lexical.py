"""A stored lexical index for repeated searches.

:func:`build` writes the postings ``(term, key, tf, n_terms)`` of a text table sorted by term, and one row
of statistics.  :func:`ranked` reads the postings of a query's terms only: the condition on the term
reaches the Parquet scan, which skips the row groups of other terms.  Terms are in lower case and
without the marks of Latin letters.  A new build goes to a new folder and is named by a marker when it
is whole, so searches go on over the old one meanwhile.

Defined results: null and empty texts have no postings but count as records; records with a null key
are left out; a query without terms finds nothing; repeated keys are refused by nothing and add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.durable import Workspace
from cairn.functions import text
from cairn.operators import retrieval


def postings(df: DataFrame, key: str, body: Column) -> DataFrame:
    """``(term, key, tf, n_terms)``; counts are reduced before the shuffle."""
    split = df.where(F.col(key).isNotNull()).select(key, retrieval.terms(text.folded(body)).alias("_terms"))
    each = split.select(key, F.size("_terms").alias("n_terms"), F.explode("_terms").alias("term"))
    return each.groupBy(key, "term").agg(F.count("*").cast("int").alias("tf"), F.first("n_terms").alias("n_terms")).select("term", key, "tf", "n_terms")


def build(df: DataFrame, key: str, body: Column, path: str, partitions: int | None = None) -> None:
    """Write the index of ``body`` below ``path``; an index that is there stays readable until this one is whole."""
    spark = df.sparkSession
    path = path.rstrip("/")
    number = 1 + max((int(n.split("-")[1]) for n in Workspace.names(spark, path) if n.startswith(("begun-", "whole-"))), default=0)
    Workspace.mark(spark, f"{path}/begun-{number}")
    found = postings(df, key, body)
    ordered = (found.repartitionByRange(partitions, "term", key) if partitions else found.repartitionByRange("term", key)).sortWithinPartitions("term", key)
    ordered.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings-{number}")
    told = df.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"))
    size = spark.read.parquet(f"{path}/postings-{number}").agg(F.sum("tf").alias("terms"))
    told.crossJoin(size).coalesce(1).write.parquet(f"{path}/statistics-{number}")  # one row each
    Workspace.mark(spark, f"{path}/whole-{number}")


def _current(spark: SparkSession, path: str) -> int:
    whole = [int(n.split("-")[1]) for n in Workspace.names(spark, path) if n.startswith("whole-")]
    if not whole:
        raise FileNotFoundError(f"no index in {path}")
    return max(whole)


def ranked(spark: SparkSession, path: str, key: str, query: str) -> DataFrame:
    """``(key, score)`` of the records with any term of ``query``, by BM25."""
    path = path.rstrip("/")
    number = _current(spark, path)
    words = retrieval.plain_words(text.fold(query))
    if not words:
        return spark.read.parquet(f"{path}/postings-{number}").limit(0).select(key, F.lit(0.0).alias("score"))
    n, total = spark.read.parquet(f"{path}/statistics-{number}").first()
    found = spark.read.parquet(f"{path}/postings-{number}").where(F.col("term").isin(words))
    frequency = found.groupBy("term").agg(F.count_distinct(key).alias("_d"))
    scored = found.join(F.broadcast(frequency), "term")  # one row a term of the query
    part = retrieval._bm25_part(F.col("tf"), F.col("n_terms"), F.lit(float(n)), F.lit((total or 0) / max(n, 1)), F.col("_d"))
    return scored.groupBy(key).agg(F.sum(part).alias("score"))
