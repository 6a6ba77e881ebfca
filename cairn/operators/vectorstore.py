"""A collection of vectors by id: checked upserts, filtered exact search, hydration of hits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import vectors


def checked(points: DataFrame, vector: str, dims: int) -> DataFrame:
    """``points``, failing when read if a vector is null or has another length than ``dims``."""
    wrong = F.col(vector).isNull() | (F.size(vector) != dims)
    told = F.raise_error(F.concat(F.lit(f"a vector of {dims} dimensions is asked for, not of "), F.coalesce(F.size(vector), F.lit(-1)).cast("string"))).cast(points.schema[vector].dataType)
    return points.withColumn(vector, F.when(wrong, told).otherwise(F.col(vector)))


def dimensions(points: DataFrame, vector: str) -> int | None:
    """The length of the collection's vectors; None for an empty one."""
    found = points.select(F.size(vector).alias("n")).limit(1).first()
    return found["n"] if found else None


def upsert(old: DataFrame, new: DataFrame, key: str, vector: str) -> DataFrame:
    """The collection after an upsert: new points replace old ones of the same id.

    New vectors must have the collection's length.  Of new points with the same id the greatest by all columns
    is kept, so that the result does not depend on their order.  Points without an id are left out.
    """
    dims = dimensions(old, vector)
    fresh = new if dims is None else checked(new, vector, dims)
    rest = [c for c in new.columns if c != key]
    one = fresh.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, "_r.*")
    kept = old.where(F.col(key).isNotNull()).join(one.select(key), key, "left_anti")
    return kept.unionByName(one, allowMissingColumns=True)


def search(points: DataFrame, key: str, vector: str, query: Sequence[float], limit: int, must: Sequence[Column] = (), must_not: Sequence[Column] = ()) -> DataFrame:
    """``(place, key, score)`` of the ``limit`` nearest points by cosine, ties by id.

    Conditions are applied before the cut, so the result is exact: every condition of ``must`` holds,
    none of ``must_not`` (an unknown one does not).
    """
    keep = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in must] + [~F.coalesce(c, F.lit(False)) for c in must_not], F.lit(True))
    asked = F.array(*(F.lit(float(x)) for x in query))
    scored = points.where(keep & F.col(vector).isNotNull()).select(key, vectors.cosine(F.col(vector), asked).alias("score"))
    order = [F.desc(F.round("score", 9)), F.col(key)]
    return scored.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", key, "score")


def hydrate(hits: DataFrame, rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Hits with their rows, in the order of the hits; hits without a row drop out before the cut."""
    found = hits.join(rows, key).orderBy("place").limit(limit)
    return found.withColumn("place", F.row_number().over(Window.orderBy("place")))
