"""Exact order statistics of skewed groups.

The values of a group are never sorted in one task.  A mergeable sketch brackets each rank to a share
of :data:`ACCURACY` of the group; rows outside the brackets are counted, those inside are reduced to
distinct values with counts, and only these few are put in order.  Groups of up to twice as many rows
are their own bracket.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch places a share within one part of this many.
ACCURACY = 10_000


def values_at(df: DataFrame, group: str, value: str, ranks: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """``(group, n, <name>...)``: the values at given ranks of each group, by ascending value.

    ``ranks``: name to (share, rank from 0 as a function of the group's size); the share only has to lie
    within half a thousandth of the rank's.  Nulls are left out, NaN is the largest value, a null group is a group;
    a group without values has no row.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(value).alias("_v")).where("_v is not null")
    real = rows.where(~F.isnan("_v")) if dict(df.dtypes)[value] in ("double", "float") else rows
    size = rows.groupBy("_g").agg(F.count("*").alias("_n"))
    ends = sorted({min(1.0, max(0.0, share + d)) for share, _ in ranks.values() for d in (-6 / ACCURACY, 6 / ACCURACY)})
    marks = real.groupBy("_g").agg(F.percentile_approx("_v", ends, 2 * ACCURACY).alias("_m"), F.count("*").alias("_real"))
    known = size.join(marks, size["_g"].eqNullSafe(marks["_g"]), "left").select(size["_g"], "_n", "_real", "_m")
    near = real.join(known.select(F.col("_g").alias("_k"), "_m", "_real"), F.col("_g").eqNullSafe(F.col("_k")))
    found = []
    for name, (share, rank) in ranks.items():
        low, high = (F.col("_m")[ends.index(min(1.0, max(0.0, share + d)))] for d in (-6 / ACCURACY, 6 / ACCURACY))
        found.append((name, rank, low, high))
    parts = []
    for name, rank, low, high in found:
        few = F.col("_real") <= 2 * ACCURACY  # a rank off by one would leave the bracket of a small group
        inside = few | ((F.col("_v") >= low) & (F.col("_v") <= high))
        counts = near.groupBy("_g", F.when(inside, F.col("_v")).alias("_x")).agg(F.count_if(inside).alias("_c"), F.count_if(~inside & (F.col("_v") < low)).alias("_b"))
        w = Window.partitionBy("_g").orderBy(F.asc_nulls_first("_x"))
        upto = counts.withColumn("_hi", F.sum(F.col("_c") + F.col("_b")).over(w))
        sized = upto.join(known.select(F.col("_g").alias("_k"), "_n"), F.col("_g").eqNullSafe(F.col("_k")))
        hit = sized.where(F.col("_x").isNotNull() & (rank(F.col("_n")) < F.col("_hi")) & (rank(F.col("_n")) >= F.col("_hi") - F.col("_c")))
        parts.append((name, rank, hit.select(F.col("_g").alias("_k"), F.col("_x").alias(name))))

    def attach(base: DataFrame, part: tuple) -> DataFrame:
        name, rank, hit = part
        joined = base.join(hit, F.col("_g").eqNullSafe(F.col("_k")), "left").drop("_k")
        beyond = rank(F.col("_n")) >= F.coalesce(F.col("_real"), F.lit(0))
        return joined.withColumn(name, F.when(beyond & F.col(name).isNull(), F.lit(float("nan"))).otherwise(F.col(name))) if dict(df.dtypes)[value] in ("double", "float") else joined

    out = reduce(attach, parts, known.drop("_m"))
    return out.select(F.col("_g").alias(group), F.col("_n").alias("n"), *ranks)
