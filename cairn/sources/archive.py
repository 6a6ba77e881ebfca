"""The canonical archive model over the stored tables.

Documents are artifacts (one per document); conversation segments, derived objects and links come
from their own tables.  All builders are plain projections, so filters and column pruning reach the
Parquet scans.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.tables import table

STATUSES = ("pending", "running", "completed", "partial", "failed")


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    """One artifact per document."""
    doc = table(spark, d, "documents")
    status = F.element_at(F.array(*(F.lit(s) for s in STATUSES)), (F.col("doc_id") % 5 + 1).cast("int"))
    lang = F.lower(F.coalesce("lang", F.lit("und")))
    return doc.select(
        F.concat(F.lit("doc-"), "doc_id").alias("artifact_id"),
        "doc_id",
        F.col("source").alias("source_type"),
        "title",
        lang.alias("lang"),
        F.concat_ws("/", "source", lang, F.concat("doc_id", F.lit(".md"))).alias("path_key"),
        F.col("account_key"),
        F.unix_micros("captured_at").alias("captured_us"),
        status.alias("enrichment_status"),
        F.col("text").alias("body"),
    )


@dataclass(frozen=True)
class Filters:
    """Optional conditions on artifacts; those left None do not count.  The time range is half open."""

    source_type: str | None = None
    enrichment_status: str | None = None
    tag: str | None = None
    alias: str | None = None
    path_prefix: str | None = None
    captured_from_us: int | None = None
    captured_before_us: int | None = None

    def any(self) -> bool:
        """Whether a condition is set."""
        return any(x is not None for x in astuple(self))


def filtered(spark: SparkSession, d: str, f: Filters) -> DataFrame:
    """The artifacts that meet all conditions set; tags and aliases are looked up by semi joins."""
    a = artifacts(spark, d)
    for column, value in (("source_type", f.source_type), ("enrichment_status", f.enrichment_status)):
        a = a if value is None else a.where(F.col(column) == value)
    if f.path_prefix is not None:
        a = a.where(F.lower("path_key").startswith(f.path_prefix.lower()))
    a = a if f.captured_from_us is None else a.where(F.col("captured_us") >= f.captured_from_us)
    a = a if f.captured_before_us is None else a.where(F.col("captured_us") < f.captured_before_us)
    if f.tag is not None:
        a = a.join(tags(spark, d).where(F.col("tag") == f.tag.lower()).select("artifact_id"), "artifact_id", "left_semi")
    if f.alias is not None:
        a = a.join(aliases(spark, d).where(F.col("alias") == text.alias(F.lit(f.alias))).select("artifact_id"), "artifact_id", "left_semi")
    return a


def tags(spark: SparkSession, d: str) -> DataFrame:
    """``(artifact_id, tag, seq)``: language and source of each artifact."""
    a = artifacts(spark, d)
    return a.select("artifact_id", F.posexplode(F.array("lang", F.concat(F.lit("src/"), "source_type"))).alias("seq", "raw")).select("artifact_id", text.tag(F.col("raw")).alias("tag"), "seq").where("tag <> ''")


def aliases(spark: SparkSession, d: str) -> DataFrame:
    """``(artifact_id, alias, alias_text)``: the title, where there is one, normalised and as it stands."""
    return artifacts(spark, d).where("title is not null").select("artifact_id", text.alias(F.col("title")).alias("alias"), F.col("title").alias("alias_text")).where("alias <> ''")


def segments(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Segments, each once: of repeated deliveries the first one, with the columns asked for.

    Columns must be named because an aggregate over whole rows would read and shuffle all of them.
    """
    raw = table(spark, d, "oa_segment")
    first = raw.groupBy("segment_id").agg(F.min_by(F.struct(*columns), F.struct("created_at", "artifact_id", "sequence_no")).alias("s"))
    return first.select("segment_id", "s.*")


def objects(spark: SparkSession, d: str) -> DataFrame:
    """Derived knowledge objects; an empty candidate key is none."""
    return table(spark, d, "oa_derived_object").withColumn("candidate_key", F.nullif(F.trim("candidate_key"), F.lit("")))


def links(spark: SparkSession, d: str) -> DataFrame:
    """Proper object links: both ends given and different, each (source, target, type) once."""
    raw = table(spark, d, "oa_archive_link").where("source_object_id is not null and target_object_id is not null and source_object_id <> target_object_id")
    best = raw.groupBy("source_object_id", "target_object_id", "link_type").agg(F.min(F.struct("archive_link_id", "confidence_score")).alias("l"))
    return best.select("source_object_id", "target_object_id", "link_type", "l.archive_link_id", "l.confidence_score")


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """The job event log: one event per row, the artifact is the user, the type gives the status."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "purchase", "retryable").otherwise("failed")
    return e.select(
        F.concat(F.lit("job-"), "event_id").alias("job_id"),
        F.concat(F.lit("artifact-"), "user_id").alias("artifact_id"),
        F.element_at(F.array(F.lit("artifact_extract"), F.lit("artifact_reconcile"), F.lit("object_embedding")), (F.col("event_id") % 3 + 1).cast("int")).alias("job_type"),
        status.alias("job_status"),
        F.get_json_object("props", "$.k").cast("int").alias("priority_no"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("available_us"),
        F.col("value").alias("duration"),
    )


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group in an order (a rank filter, which the planner limits per group)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
