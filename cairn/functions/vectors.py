"""Vectors as arrays: similarity, the deterministic stand-in embedding, literals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, not below 0; null for a zero vector."""
    return F.greatest(F.lit(0.0), F.try_divide(dot(a, b), norm(a) * norm(b)))


def literal(a: Column) -> Column:
    """``[x,y,...]`` with eight decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string("%.8f", x)), ","), F.lit("]"))


def parse(c: Column) -> Column:
    """An array of floats from its literal."""
    return F.from_json(c, "array<float>")


def stub_embedding(text: str, dim: int) -> list[float]:
    """Bytes folded into ``dim`` slots and scaled to length 1."""
    data = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.float64)
    out = np.zeros(dim)
    np.add.at(out, np.arange(len(data)) % dim, (data - 127.0) / 127.0)
    size = np.linalg.norm(out)
    return (out / size if size else out).astype(np.float32).tolist()


def embed(c: Column, dim: int = 64) -> Column:
    """The stand-in embedding of a text column."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: stub_embedding(t or "", dim))

    return run(c)


def clustered(spark: SparkSession, n: int, dims: int, centres: int = 16, noise: float = 0.015, seed: int = 7) -> DataFrame:
    """``(vec_id, cluster, embedding)``: unit vectors around sine-shaped centres, the same for the same arguments.

    Every number is a function of its id, place and seed, so rows are made where they are needed.
    """
    ids = spark.range(n).select(F.col("id").alias("vec_id"), (F.col("id") % centres).cast("int").alias("cluster"))

    def value(j: Column) -> Column:
        chance = F.pmod(F.xxhash64("vec_id", j, F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
        return F.sin((F.col("cluster") + 1) * (j + 1) * 0.37) + (chance * 2 - 1) * noise

    raw = ids.withColumn("_raw", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), value))
    size = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda total, x: total + x * x))
    return raw.withColumn("_size", size).select("vec_id", "cluster", F.transform("_raw", lambda x: (x / F.col("_size")).cast("float")).alias("embedding"))
