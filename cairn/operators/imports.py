"""Idempotent imports, set-wise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_type", "hash_version", "content_hash"]


def plan_import(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What becomes of each incoming artifact: ``outcome`` and the ``final_id`` it maps to.

    An artifact whose (source, hash version, hash) is there already maps to the existing id; of equal
    ones in the same import the first, by id, is written and the others map to it.  A null content
    hash or source cannot be imported (``failed``).  Both look-ups are equi-joins on the triple.
    """
    bad = F.col("source_type").isNull() | F.col("content_hash").isNull()
    first = F.min("artifact_id").over(Window.partitionBy(*KEY))
    known = existing.groupBy(*KEY).agg(F.min("artifact_id").alias("_known"))
    seen = incoming.withColumn("_first", F.when(~bad, first)).join(known, KEY, "left")
    final = F.when(bad, None).otherwise(F.coalesce("_known", "_first"))
    outcome = F.when(bad, "failed").when(F.col("_known").isNotNull() | (F.col("_first") != F.col("artifact_id")), "already_exists").otherwise("imported")
    return seen.withColumn("final_id", final).withColumn("outcome", outcome).drop("_first", "_known")


def remap(rows: DataFrame, planned: DataFrame, column: str = "artifact_id") -> DataFrame:
    """Child rows of imported artifacts only, under their final ids."""
    ids = planned.where("outcome = 'imported'").select(F.col("artifact_id").alias(column), F.col("final_id").alias("_final"))
    return rows.join(ids, column).withColumn(column, F.col("_final")).drop("_final")


def summary(planned: DataFrame) -> DataFrame:
    """Counts by outcome."""
    return planned.groupBy("outcome").agg(F.count("*").alias("n"))


def first_match(candidates: DataFrame, existing: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Candidates with the first existing record (by id) of the same keys, or null; blank keys match nothing."""
    usable = existing.where(" and ".join(f"{k} is not null and trim({k}) <> ''" for k in keys))
    first = usable.groupBy(*keys).agg(F.min(ident).alias("matched_id"))
    return candidates.join(first, keys, "left")


def append_unique(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """``first``, then what ``second`` has under other keys."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def write_outcomes(rows: DataFrame, batch: str, key: str, order: str) -> DataFrame:
    """``(batch, n_created, n_existing, n_failed, status)`` of imports written as sets.

    ``rows(batch, key, order, error)``: a row with an error fails alone; of the others the first of each
    key is created and the rest exist already.  A null batch is a batch.
    """
    from pyspark.sql import functions as F

    first = rows.where("error is null").groupBy(key).agg(F.min(order).alias("_first"))
    told = rows.join(first, key, "left")
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col(order) == F.col("_first"), "created").otherwise("existing")
    counts = told.groupBy(batch).agg(*(F.count_if(outcome == k).alias(f"n_{k}") for k in ("created", "existing", "failed")))
    status = F.when(F.col("n_failed") == 0, "completed").when(F.col("n_created") + F.col("n_existing") == 0, "failed").otherwise("completed_with_errors")
    return counts.withColumn("status", status)


def payloads(rows: DataFrame, content: str) -> DataFrame:
    """``(sha256, payload)``: every distinct content once, by its digest."""
    from pyspark.sql import functions as F

    return rows.where(F.col(content).isNotNull()).groupBy(F.sha2(content, 256).alias("sha256")).agg(F.first(content).alias("payload"))


def manifest(files: DataFrame, vault: str, path: str, content: str) -> DataFrame:
    """``(vault, path, sha256, entry)``: one JSON entry a file; written sorted by vault and path it is the vault's manifest."""
    from pyspark.sql import functions as F

    digest = F.sha2(content, 256)
    entry = F.to_json(F.struct(F.col(path).alias("path"), digest.alias("sha256"), F.octet_length(content).alias("bytes")))
    return files.select(vault, path, digest.alias("sha256"), entry.alias("entry"))


def stride(rows: DataFrame, order: str, n: int) -> DataFrame:
    """``(order, place)`` of ``n`` rows at equal strides of their rank by a unique column.

    Ranks are counted within ranges of the order and moved by the sizes of the ranges before, so no
    task sorts all rows; the sizes, one row a range, are what one task adds up.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from cairn.durable import Workspace

    spark = rows.sparkSession
    # written once: ranges are cut by sampling, and a range must not change between the two reads
    cut = Workspace(spark, "stride").cut(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("_p").agg(F.count("*").alias("_n"), F.min(order).alias("_least"))
    whole = Window.orderBy("_least")
    before = sizes.select("_p", (F.sum("_n").over(whole) - F.col("_n")).alias("_before"), F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    placed = cut.withColumn("_own", own).join(F.broadcast(before), "_p").withColumn("place", (F.col("_before") + F.col("_own")).cast("long"))
    step = F.greatest(F.lit(1), F.expr(f"_all div {int(n)}"))
    return placed.where((F.col("place") % step == 0) & (F.floor(F.col("place") / step) < n)).select(order, "place")


def validate_derivations(objects: DataFrame, segments: DataFrame, links: DataFrame) -> DataFrame:
    """``(kind, ident, error)`` of everything that makes a derivation invalid; what is not listed may be written.

    ``objects(derived_object_id, artifact_id, scope_type, scope_id)``: the artifact must be known, an id
    occur once, and the scope be the artifact itself or one of its segments.  ``links(archive_link_id,
    source_object_id, target_object_id)``: both ends must be objects, and differ.
    """
    from pyspark.sql import functions as F

    known = segments.select("artifact_id").distinct().withColumn("_known", F.lit(True))
    owned = segments.select(F.col("segment_id").alias("scope_id"), F.col("artifact_id").alias("_owner")).distinct()
    told = objects.join(known, "artifact_id", "left").join(owned, "scope_id", "left")
    scope = F.when(F.col("scope_type") == "artifact", F.col("scope_id") == F.col("artifact_id")).when(F.col("scope_type") == "segment", F.col("_owner") == F.col("artifact_id")).otherwise(F.lit(False))
    per = told.groupBy("derived_object_id").agg(F.min("scope_type").alias("_t"), F.bool_and(F.col("_known").isNotNull()).alias("_k"), F.max(F.coalesce(scope, F.lit(False))).alias("_s"))
    twice = objects.groupBy("derived_object_id").count().where("count > 1").select("derived_object_id", F.lit(True).alias("_twice"))
    wrong = per.join(twice, "derived_object_id", "left").select("derived_object_id", F.explode(F.array_compact(F.array(F.when(~F.col("_k"), "unknown_artifact"), F.when(~F.col("_s"), "foreign_scope"), F.when(F.col("_twice"), "repeated_id")))).alias("error"))
    ids = objects.select(F.col("derived_object_id").alias("_id")).distinct()
    ends = links
    for side in ("source", "target"):
        ends = ends.join(ids.select(F.col("_id").alias(f"{side}_object_id"), F.lit(True).alias(f"_{side}")), f"{side}_object_id", "left")
    fault = F.when(F.col("_source").isNull() | F.col("_target").isNull(), "unknown_end").when(F.col("source_object_id") == F.col("target_object_id"), "self_link")
    bad = ends.select(F.col("archive_link_id").alias("ident"), fault.alias("error")).where("error is not null")
    return wrong.select(F.lit("object").alias("kind"), F.col("derived_object_id").alias("ident"), "error").unionByName(bad.select(F.lit("link").alias("kind"), "ident", "error"))
