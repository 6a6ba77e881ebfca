"""Consolidating pairwise matches into groups: minimum-label propagation with pointer jumping.

Every round works on a contracted graph.  Each node takes the least label among itself and its
neighbours; the pointers so made always point to a smaller label, so they form a forest, and doubling
them (``p := p of p``) until nothing changes turns every tree into a star, however long the chain
was.  The edges are then rewritten to the roots, duplicates and loops dropped, and the next round
starts on that much smaller graph.  When no edge is left, the round maps are composed from the last
to the first.  Rounds and doublings are each logarithmic in practice; nothing is ever collected.

Skew: the minimum is a partially aggregated ``min``, so a node with a third of all edges is reduced
before the shuffle; joins are keyed by node, with at most one row per key on the map side, so
adaptive skew handling can split the edge side.  Each round's tables are written to the shared
checkpoint folder, which cuts lineage and lets a lost executor's work be redone from there.

Defined results: pairs with a null end and self pairs are ignored, so objects seen only in such pairs
have no group; repeated and reversed pairs count once; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.durable import Workspace


def _jump(labels: DataFrame, space: Workspace) -> DataFrame:
    """Double the pointers ``(v, p)`` until every one leads to a root; each table goes when the next stands."""
    stored, pointers = labels, labels
    while True:
        onward = pointers.select(F.col("v").alias("p"), F.col("p").alias("next"))
        moved = space.cut(pointers.join(onward, "p", "left").select("v", F.coalesce("next", "p").alias("p"), (F.coalesce("next", "p") != F.col("p")).alias("moved")), "jump")
        space.release(stored)
        stored, pointers = moved, moved.select("v", "p")
        if moved.where("moved").isEmpty():
            return stored


def connected_components(pairs: DataFrame, left: str, right: str, node: str = "node", group: str = "group_id") -> DataFrame:
    """``(node, group)`` for every node that has a pair with another one.

    ``group`` is the least node of the connected component, in the order of the column's type (byte
    order for strings).
    """
    space = Workspace(pairs.sparkSession, "components")
    ends = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b")
    edges = space.cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias(node), F.col("b").alias(group))
    maps: list[DataFrame] = []
    while True:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("n")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("n")))
        least = both.groupBy("v").agg(F.min("n").alias("n")).select("v", F.least("v", "n").alias("p"))
        stars = _jump(space.cut(least, "labels"), space)
        maps.append(stars)
        before = edges
        to_a = stars.select(F.col("v").alias("a"), F.col("p").alias("ra"))
        to_b = stars.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        rewritten = edges.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        edges = space.cut(rewritten.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        space.release(before)
        if edges.isEmpty():
            break
    final = maps.pop()
    while maps:
        deeper, last = maps.pop(), final
        onward = last.select(F.col("v").alias("p"), F.col("p").alias("root"))
        final = space.cut(deeper.join(onward, "p", "left").select("v", F.coalesce("root", "p").alias("p")), "composed")
        space.release(deeper)
        space.release(last)
    return final.select(F.col("v").alias(node), F.col("p").alias(group))
