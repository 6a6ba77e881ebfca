"""Edges between objects and artifacts: neighbours, shared keys, structural links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def symmetric(edges: DataFrame, source: str, target: str, *keep: str) -> DataFrame:
    """``(node, neighbour, ...)`` in both directions."""
    there = edges.select(F.col(source).alias("node"), F.col(target).alias("neighbour"), *keep)
    back = edges.select(F.col(target).alias("node"), F.col(source).alias("neighbour"), *keep)
    return there.unionByName(back)


def neighbours(starts: DataFrame, edges: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    """``(node, neighbour, kind)`` of the nodes in ``starts(node)``; the start set filters both directions first."""
    out = edges.join(starts.select(F.col("node").alias(source)), source).select(F.col(source).alias("node"), F.col(target).alias("neighbour"), F.col(kind).alias("kind"))
    into = edges.join(starts.select(F.col("node").alias(target)), target).select(F.col(target).alias("node"), F.col(source).alias("neighbour"), F.col(kind).alias("kind"))
    return out.unionByName(into)


def shared_key(starts: DataFrame, objects: DataFrame, key: str, ident: str, limit: int = 20, own: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` objects, by id, that share a non-empty key with a start: ``(node, neighbour, key)``.

    Of each key only its first ``limit + 1`` members can be among a start's neighbours, one being
    the start itself, so a key with m members and s starts gives ``s * limit`` rows and never
    ``s * m``; a hot key is ranked by a group limit, which prunes before the shuffle.  Null and empty
    keys join nothing; repeated objects count once.  ``own`` brings the starts' keys where ``objects``
    leaves starts out.
    """
    keyed = objects.where(F.col(key).isNotNull() & (F.col(key) != "")).select(F.col(ident).alias("neighbour"), F.col(key).alias("key")).distinct()
    top = Window.partitionBy("key").orderBy("neighbour")
    first = keyed.withColumn("_rn", F.row_number().over(top)).where(F.col("_rn") <= limit + 1).drop("_rn")
    mine = keyed if own is None else own.where(F.col(key).isNotNull() & (F.col(key) != "")).select(F.col(ident).alias("neighbour"), F.col(key).alias("key")).distinct()
    own = starts.select("node").distinct().join(mine.withColumnRenamed("neighbour", "node"), "node")
    met = own.join(first, "key").where("node <> neighbour")
    best = Window.partitionBy("node").orderBy("neighbour")
    return met.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= limit).select("node", "neighbour", "key")


def related(starts: DataFrame, edges: DataFrame, objects: DataFrame, key: str, ident: str, limit: int = 20, own: DataFrame | None = None, alive: DataFrame | None = None) -> DataFrame:
    """The ``limit`` nearest objects of each start: linked ones first, by edge id, then those sharing a key, by id.

    ``(node, neighbour, relation, place)``; ``edges(source, target, edge_id)``.  Each neighbour counts
    once, by its best relation; a busy node's edges are cut by a group limit.  ``alive(neighbour)``
    restricts linked neighbours, ``objects`` those sharing a key.
    """
    both = symmetric(edges, "source", "target", "edge_id").join(starts.select("node").distinct(), "node")
    both = both if alive is None else both.join(alive, "neighbour", "left_semi")
    linked = both.groupBy("node", "neighbour").agg(F.min("edge_id").alias("edge_id"))
    linked = linked.withColumn("_rn", F.row_number().over(Window.partitionBy("node").orderBy("edge_id", "neighbour"))).where(F.col("_rn") <= limit)
    found = linked.select("node", "neighbour", F.lit(0).alias("_branch"), F.col("edge_id").alias("_order"))
    keyed = shared_key(starts, objects, key, ident, 2 * limit, own)  # so many that linked ones leave enough
    found = found.unionByName(keyed.select("node", "neighbour", F.lit(1).alias("_branch"), F.col("neighbour").alias("_order")))
    once = found.groupBy("node", "neighbour").agg(F.min(F.struct("_branch", "_order")).alias("b"))
    w = Window.partitionBy("node").orderBy("b._branch", "b._order", "neighbour")
    ranked = once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return ranked.select("node", "neighbour", F.when(F.col("b._branch") == 0, "link").otherwise("shared_key").alias("relation"), "place")


def first_seen(df: DataFrame, keys: list[str], rank: Column, *ties: str) -> DataFrame:
    """The first row of each key by rank: an order-preserving de-duplication."""
    w = Window.partitionBy(*keys).orderBy(rank, *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def groups_by_value(items: DataFrame, member: str, value: str) -> DataFrame:
    """Members linked through a shared value, as a star: ``(value, hub, member, n_members)``.

    A value shared by m members would make m * (m - 1) / 2 pairs; the star from the least member says
    the same with m rows: two members are linked when they share value and hub.
    """
    own = items.where(F.col(value).isNotNull() & (F.col(value) != "")).select(value, member).distinct()
    hub = own.groupBy(value).agg(F.min(member).alias("hub"), F.count("*").alias("n_members")).where("n_members > 1")
    return own.join(hub, value).select(value, "hub", member, "n_members")


def keyed_elsewhere(objects: DataFrame, owner: str, key: str, ident: str, limit: int) -> DataFrame:
    """The first ``limit`` objects, by key and id, that share a key with an owner's objects but belong to others.

    ``(owner, ident, place)``.  Of a key's members at most ``limit`` of each owner, and of those the first
    ``2 * limit``, can be among any owner's neighbours, so a hot key is cut to these before it is joined.
    """
    keyed = objects.where(F.col(key).isNotNull() & (F.col(key) != "") & F.col(owner).isNotNull()).select(F.col(owner).alias("_of"), F.col(key).alias("_key"), ident).distinct()
    mine = Window.partitionBy("_key", "_of").orderBy(ident)
    few = keyed.withColumn("_rn", F.row_number().over(mine)).where(F.col("_rn") <= limit)
    few = few.withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy(ident))).where(F.col("_rn") <= 2 * limit)
    met = keyed.select(F.col("_of").alias(owner), "_key").distinct().join(few.drop("_rn"), "_key").where(F.col(owner) != F.col("_of"))
    best = Window.partitionBy(owner).orderBy("_key", ident)
    return met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).select(owner, ident, "place")


def structural(aliases: DataFrame, tags: DataFrame, named: DataFrame) -> DataFrame:
    """``(kind, source, target, value)``: members of shared aliases and tags to their hubs, and ``named(artifact_id, alias)``
    to the one artifact that bears the alias."""
    star = lambda df, value, kind: groups_by_value(df, "artifact_id", value).where("artifact_id <> hub").select(F.lit(kind).alias("kind"), F.col("artifact_id").alias("source"), F.col("hub").alias("target"), F.col(value).alias("value"))
    told = resolve_unique(named.select(F.col("artifact_id").alias("source"), F.col("alias").alias("value")), "value", aliases, "alias", "artifact_id")
    told = told.where("resolved is not null and source <> resolved").select(F.lit("mention").alias("kind"), "source", F.col("resolved").alias("target"), "value")
    return star(aliases, "alias", "shared_alias").unionByName(star(tags, "tag", "shared_tag")).unionByName(told)


def resolve_unique(links: DataFrame, target: str, owners: DataFrame, name: str, owner: str) -> DataFrame:
    """Links whose target name exactly one owner bears, with that owner; others keep null."""
    unique = owners.groupBy(name).agg(F.count_distinct(owner).alias("_n"), F.min(owner).alias("resolved")).where("_n = 1").select(F.col(name).alias(target), "resolved")
    return links.join(unique, target, "left")


def both_ends(edges: DataFrame, source: str, target: str, objects: DataFrame, ident: str, of: str) -> DataFrame:
    """Edges lifted to the owners of both ends; ends without a row and edges within one owner drop out."""
    o = objects.select(F.col(ident).alias("_id"), F.col(of).alias("_of"))
    a = o.select(F.col("_id").alias(source), F.col("_of").alias("source_owner"))
    b = o.select(F.col("_id").alias(target), F.col("_of").alias("target_owner"))
    return edges.join(a, source).join(b, target).where("source_owner <> target_owner")
