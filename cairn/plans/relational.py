"""Filters, joins, aggregations, windows, top-k and set operations over the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import ranks
from cairn.plans.registry import Registry
from cairn.sources import archive
from cairn.tables import table

R = Registry()

ART = """art AS (SELECT 'doc-' || doc_id AS artifact_id, doc_id, source AS source_type, title, lower(coalesce(lang, 'und')) AS lang,
    source || '/' || lower(coalesce(lang, 'und')) || '/' || doc_id || '.md' AS path_key, account_key, epoch_us(captured_at) AS captured_us,
    CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'partial' ELSE 'failed' END AS enrichment_status,
    text AS body FROM documents)"""
TAG = "tag AS (SELECT artifact_id, lang AS tag, 0 AS seq FROM art UNION ALL SELECT artifact_id, 'src/' || source_type, 1 FROM art)"
SEG = """seg AS (SELECT segment_id, artifact_id, sequence_no, participant_id, segment_type, text_content FROM (
    SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY created_at, artifact_id, sequence_no) AS rn FROM oa_segment) WHERE rn = 1)"""
OBJ = "obj AS (SELECT * REPLACE (nullif(trim(candidate_key), '') AS candidate_key) FROM oa_derived_object)"
LNK = """lnk AS (SELECT source_object_id, target_object_id, link_type, min(archive_link_id) AS archive_link_id FROM oa_archive_link
    WHERE source_object_id IS NOT NULL AND target_object_id IS NOT NULL AND source_object_id <> target_object_id GROUP BY 1, 2, 3)"""


@R.query(
    sql=f"""WITH {ART} SELECT artifact_id, source_type, captured_us, enrichment_status FROM art
    WHERE source_type = 'markdown_file' AND lower(coalesce(path_key, '')) LIKE 'markdown_file/en%' AND captured_us >= 1704067200000000 AND captured_us < 1767225600000000
    ORDER BY captured_us DESC, artifact_id LIMIT 50 OFFSET 10"""
)
def list_filtered_paged(spark: SparkSession, d: str) -> DataFrame:
    """Optional filters, half-open time range, path prefix, one page (the page is the feature)."""
    a = archive.artifacts(spark, d)
    a = a.where((F.col("source_type") == "markdown_file") & F.lower(F.coalesce("path_key", F.lit(""))).like("markdown_file/en%"))
    a = a.where((F.col("captured_us") >= 1704067200000000) & (F.col("captured_us") < 1767225600000000))
    return a.orderBy(F.desc("captured_us"), "artifact_id").offset(10).limit(50).select("artifact_id", "source_type", "captured_us", "enrichment_status")


@R.query(sql=f"WITH {ART}, {TAG} SELECT artifact_id, title FROM art a WHERE EXISTS (SELECT 1 FROM tag t WHERE t.artifact_id = a.artifact_id AND t.tag = 'de')")
def semi_tag_filter(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts that carry a tag."""
    wanted = archive.tags(spark, d).where(F.col("tag") == "de").select("artifact_id")
    return archive.artifacts(spark, d).select("artifact_id", "title").join(wanted, "artifact_id", "left_semi")


@R.query(
    sql=f"""WITH {OBJ}, ranked AS (SELECT artifact_id, derived_object_id, title, confidence_score,
        row_number() OVER (PARTITION BY artifact_id ORDER BY confidence_score DESC NULLS LAST, derived_object_id) AS rn
        FROM obj WHERE derived_object_type = 'summary' AND object_status = 'active')
    SELECT artifact_id, derived_object_id AS summary_id, title AS summary_title, confidence_score FROM ranked WHERE rn = 1"""
)
def best_summary(spark: SparkSession, d: str) -> DataFrame:
    """The best active summary of each artifact."""
    o = archive.objects(spark, d).where((F.col("derived_object_type") == "summary") & (F.col("object_status") == "active"))
    best = archive.first_per(o, ["artifact_id"], [F.desc_nulls_last("confidence_score"), "derived_object_id"])
    return best.select("artifact_id", F.col("derived_object_id").alias("summary_id"), F.col("title").alias("summary_title"), "confidence_score")


@R.query(
    sql=f"""WITH {ART} SELECT artifact_id, captured_us, title FROM art WHERE title LIKE '%retry%' AND captured_us IS NOT NULL
    ORDER BY captured_us, artifact_id LIMIT 100"""
)
def timeline(spark: SparkSession, d: str) -> DataFrame:
    """A page of the timeline under a keyword."""
    a = archive.artifacts(spark, d).where(F.col("title").like("%retry%") & F.col("captured_us").isNotNull())
    return a.orderBy("captured_us", "artifact_id").limit(100).select("artifact_id", "captured_us", "title")


@R.query(
    sql=f"""WITH {ART} SELECT 'total' AS dimension, 'all' AS value, CAST(count(*) AS BIGINT) AS n FROM art
    UNION ALL SELECT 'source', source_type, count(*) FROM art GROUP BY 2
    UNION ALL SELECT 'status', enrichment_status, count(*) FROM art GROUP BY 2
    UNION ALL SELECT 'lang', lang, count(*) FROM art GROUP BY 2"""
)
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """All counts of the dashboard in one pass over the artifacts."""
    a = archive.artifacts(spark, d).select("source_type", "enrichment_status", "lang")
    cube = a.groupingSets([[], ["source_type"], ["enrichment_status"], ["lang"]], "source_type", "enrichment_status", "lang").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "source").when(F.col("g") == 5, "status").otherwise("lang")
    value = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, F.col("source_type")).when(F.col("g") == 5, F.col("enrichment_status")).otherwise(F.col("lang"))
    return cube.select(dimension.alias("dimension"), value.alias("value"), "n")


@R.query(
    sql=f"""WITH {SEG}, p AS (SELECT artifact_id, participant_id, row_number() OVER (PARTITION BY artifact_id ORDER BY first_seq, participant_id) - 1 AS participant_no
        FROM (SELECT artifact_id, participant_id, min(sequence_no) AS first_seq FROM seg WHERE participant_id IS NOT NULL GROUP BY 1, 2))
    SELECT s.segment_id, s.artifact_id, s.sequence_no, CAST(p.participant_no AS INTEGER) AS participant_no FROM seg s LEFT JOIN p ON s.artifact_id = p.artifact_id AND s.participant_id = p.participant_id"""
)
def segments_left_participant(spark: SparkSession, d: str) -> DataFrame:
    """Segments with their participant's number by first appearance; none without a participant."""
    s = archive.segments(spark, d, "artifact_id", "sequence_no", "participant_id")
    # one row per participant goes into the window, not one per segment
    seen = s.where("participant_id is not null").groupBy("artifact_id", "participant_id").agg(F.min("sequence_no").alias("first_seq"))
    order = Window.partitionBy("artifact_id").orderBy("first_seq", "participant_id")
    p = seen.select("artifact_id", "participant_id", (F.row_number().over(order) - 1).alias("participant_no"))
    return s.join(p, ["artifact_id", "participant_id"], "left").select("segment_id", "artifact_id", "sequence_no", "participant_no")


@R.query(sql=f"WITH {SEG} SELECT artifact_id, CAST(count(*) AS BIGINT) AS n_segments, CAST(coalesce(sum(length(text_content)), 0) AS BIGINT) AS n_chars FROM seg GROUP BY 1")
def segment_totals(spark: SparkSession, d: str) -> DataFrame:
    """Segments and characters of each artifact."""
    raw = table(spark, d, "oa_segment")
    size = F.min_by(F.struct("artifact_id", F.length("text_content").alias("n")), F.struct("created_at", "artifact_id", "sequence_no"))  # the length, not the text, is shuffled
    once = raw.groupBy("segment_id").agg(size.alias("s"))
    return once.groupBy("s.artifact_id").agg(F.count("*").alias("n_segments"), F.coalesce(F.sum("s.n"), F.lit(0)).alias("n_chars"))


@R.query(sql=f"WITH {OBJ} SELECT candidate_key, CAST(count(DISTINCT artifact_id) AS BIGINT) AS n_artifacts FROM obj WHERE object_status = 'active' AND candidate_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT artifact_id) > 1")
def key_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Candidate keys that several artifacts share; pairs are reduced before they are counted."""
    o = archive.objects(spark, d).where("object_status = 'active' and candidate_key is not null").select("candidate_key", "artifact_id").distinct()
    return o.groupBy("candidate_key").agg(F.count("artifact_id").alias("n_artifacts")).where("n_artifacts > 1")


@R.query(
    sql=f"""WITH {OBJ}, k AS (SELECT candidate_key, count(DISTINCT artifact_id) AS n FROM obj WHERE object_status = 'active' AND candidate_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT artifact_id) > 1)
    SELECT o.derived_object_id, o.artifact_id, o.candidate_key, CAST(k.n AS BIGINT) AS n_artifacts FROM k JOIN obj o USING (candidate_key) WHERE o.object_status = 'active'"""
)
def collided_objects(spark: SparkSession, d: str) -> DataFrame:
    """Active objects under a shared candidate key."""
    o = archive.objects(spark, d).where("object_status = 'active' and candidate_key is not null")
    return o.join(key_collisions(spark, d), "candidate_key").select("derived_object_id", "artifact_id", "candidate_key", "n_artifacts")


@R.query(
    sql=f"""WITH {SEG}, {OBJ} SELECT DISTINCT s.artifact_id FROM seg s WHERE NOT EXISTS
    (SELECT 1 FROM obj o WHERE o.artifact_id = s.artifact_id AND o.derived_object_type = 'summary' AND o.object_status = 'active')"""
)
def missing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts without an active summary."""
    done = archive.objects(spark, d).where("derived_object_type = 'summary' and object_status = 'active'").select("artifact_id")
    return table(spark, d, "oa_segment").select("artifact_id").distinct().join(done, "artifact_id", "left_anti")


@R.query(sql=f"WITH {OBJ} SELECT derived_object_id, artifact_id, confidence_score FROM obj WHERE object_status = 'active' AND confidence_score IS NOT NULL AND confidence_score < 0.60")
def low_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Active objects below a confidence; both conditions reach the scan."""
    o = table(spark, d, "oa_derived_object").where("object_status = 'active' and confidence_score is not null and confidence_score < 0.60")
    return o.select("derived_object_id", "artifact_id", "confidence_score")


@R.query(
    sql=f"""WITH {OBJ}, q AS (
        SELECT 'object_low_confidence' AS kind, derived_object_id AS item, artifact_id, 2 AS priority FROM obj WHERE object_status = 'active' AND confidence_score < 0.60
        UNION ALL SELECT 'candidate_key_collision', derived_object_id, artifact_id, 1 FROM obj WHERE object_status = 'active' AND candidate_key IN
            (SELECT candidate_key FROM obj WHERE object_status = 'active' AND candidate_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT artifact_id) > 1))
    SELECT 'review:' || kind || ':' || item AS item_id, kind, artifact_id, priority FROM q ORDER BY priority, item_id LIMIT 100"""
)
def queue_union(spark: SparkSession, d: str) -> DataFrame:
    """Several work lists under one order, the first hundred."""
    parts = [
        low_confidence(spark, d).select(F.lit("object_low_confidence").alias("kind"), F.col("derived_object_id").alias("item"), "artifact_id", F.lit(2).alias("priority")),
        collided_objects(spark, d).select(F.lit("candidate_key_collision").alias("kind"), F.col("derived_object_id").alias("item"), "artifact_id", F.lit(1).alias("priority")),
    ]
    q = parts[0].unionByName(parts[1])
    return q.select(F.concat_ws(":", F.lit("review"), "kind", "item").alias("item_id"), "kind", "artifact_id", "priority").orderBy("priority", "item_id").limit(100)


@R.query(sql="SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count_if(value > 10) AS BIGINT) AS n_large, round(sum(value), 4) AS total, round(max(value), 4) AS largest FROM events GROUP BY 1")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    """Several conditional counts in one pass."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("n_large"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 4).alias("largest"))


@R.query(
    sql="""WITH j AS (SELECT 'artifact-' || user_id AS artifact_id, event_type FROM events)
    SELECT artifact_id, CAST(count_if(event_type = 'signup') AS BIGINT) AS n_pending, CAST(count_if(event_type = 'view') AS BIGINT) AS n_running, CAST(count_if(event_type = 'purchase') AS BIGINT) AS n_retryable,
    CAST(count_if(event_type = 'click') AS BIGINT) AS n_completed, CAST(count_if(event_type = 'error') AS BIGINT) AS n_failed FROM j GROUP BY 1"""
)
def job_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Counts by status of every artifact, set-wise."""
    j = archive.jobs(spark, d).select("artifact_id", "job_status")
    return j.groupBy("artifact_id").agg(*(F.count_if(F.col("job_status") == s).alias(f"n_{s}") for s in ("pending", "running", "retryable", "completed", "failed")))


@R.query(
    sql="""SELECT 'job-' || event_id AS job_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS priority_no FROM events WHERE event_type IN ('signup', 'purchase') AND epoch_us(ts) <= 1704153600000000
    ORDER BY priority_no, ts, job_id LIMIT 25"""
)
def ordered_batch(spark: SparkSession, d: str) -> DataFrame:
    """The next batch in priority order under an explicit clock."""
    j = archive.jobs(spark, d).where(F.col("job_status").isin("pending", "retryable") & (F.col("available_us") <= 1704153600000000))
    return j.orderBy("priority_no", "available_us", "job_id").limit(25).select("job_id", "priority_no")


@R.query(
    sql="""WITH k AS (SELECT 'artifact-' || user_id AS artifact_id, event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2)
    SELECT artifact_id, string_agg(event_type || ':' || n, ' | ' ORDER BY event_type) AS messages FROM k GROUP BY 1"""
)
def message_lists(spark: SparkSession, d: str) -> DataFrame:
    """Ordered concatenation of messages per artifact, each kind with its count (reduced before it is listed)."""
    e = table(spark, d, "events").where(F.col("event_type").isin("error", "purchase"))
    kinds = e.groupBy(F.concat(F.lit("artifact-"), "user_id").alias("artifact_id"), "event_type").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    return kinds.groupBy("artifact_id").agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["event_type"], x["n"])), " | ").alias("messages"))


@R.query(
    sql="""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(CASE WHEN i = CAST(floor((n - 1) * 0.5 + 0.5) AS BIGINT) THEN value END) AS p50, max(CASE WHEN i = CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT) THEN value END) AS p95, max(value) AS largest FROM r GROUP BY 1"""
)
def percentile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles by nearest rank; no group is sorted in one task."""
    rank = lambda p: lambda n: F.floor((n - 1) * p + 0.5)
    e = table(spark, d, "events")
    found = ranks.values_at(e, "event_type", "value", {"p50": (0.5, rank(0.5)), "p95": (0.95, rank(0.95))})
    return found.join(e.groupBy("event_type").agg(F.max("value").alias("largest")), "event_type").select("event_type", "p50", "p95", "largest")


@R.query(sql="SELECT event_type, median(value) AS middle, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def median_exact(spark: SparkSession, d: str) -> DataFrame:
    """Exact median, the mean of the middle two for even counts."""
    low, high = (0.5, lambda n: F.floor((n - 1) / 2)), (0.5, lambda n: F.ceil((n - 1) / 2))
    found = ranks.values_at(table(spark, d, "events"), "event_type", "value", {"low": low, "high": high})
    return found.select("event_type", ((F.col("low") + F.col("high")) / 2).alias("middle"), "n")


@R.query(sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """A typed value out of a JSON column."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@R.query(sql="SELECT derived_object_id, json_extract_string(object_json, '$.candidate_key') AS json_key, json_extract_string(object_json, '$.memory_type') AS json_type FROM oa_derived_object")
def json_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys out of the stored payload."""
    o = table(spark, d, "oa_derived_object")
    return o.select("derived_object_id", F.get_json_object("object_json", "$.candidate_key").alias("json_key"), F.get_json_object("object_json", "$.memory_type").alias("json_type"))


@R.query(
    sql=f"""WITH {SEG}, w AS (SELECT artifact_id, segment_id AS window_id, sequence_no AS first_no, sequence_no + 4 AS last_no FROM seg WHERE segment_type = 'content_window')
    SELECT w.window_id, s.segment_id FROM w JOIN seg s ON s.artifact_id = w.artifact_id AND s.sequence_no BETWEEN w.first_no AND w.last_no WHERE s.segment_type = 'content_block'"""
)
def window_membership(spark: SparkSession, d: str) -> DataFrame:
    """Segments inside windows: the range join becomes an equi-join on (artifact, block of positions)."""
    s = archive.segments(spark, d, "artifact_id", "sequence_no", "segment_type")
    span = 8
    w = s.where("segment_type = 'content_window'").select("artifact_id", F.col("segment_id").alias("window_id"), F.col("sequence_no").alias("first_no"), (F.col("sequence_no") + 4).alias("last_no"))
    blocks = F.sequence(F.floor(F.col("first_no") / span), F.floor(F.col("last_no") / span))
    w = w.where("first_no is not null").select("*", F.explode(blocks).alias("block"))
    b = s.where("segment_type = 'content_block'").select("artifact_id", "segment_id", "sequence_no", F.floor(F.col("sequence_no") / span).alias("block"))
    return b.join(w, ["artifact_id", "block"]).where(F.col("sequence_no").between(F.col("first_no"), F.col("last_no"))).select("window_id", "segment_id")


@R.query(sql=f"WITH {OBJ} SELECT DISTINCT title FROM obj WHERE title IS NOT NULL AND derived_object_type = 'summary' ORDER BY title LIMIT 40")
def distinct_titles(spark: SparkSession, d: str) -> DataFrame:
    """The first distinct titles in order."""
    return table(spark, d, "oa_derived_object").where("title is not null and derived_object_type = 'summary'").select("title").distinct().orderBy("title").limit(40)


@R.query(sql="SELECT lower(trim(title)) AS title_key, CAST(count(*) AS BIGINT) AS n FROM documents WHERE title IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles that occur more than once."""
    return table(spark, d, "documents").where("title is not null").groupBy(text.phrase(F.col("title")).alias("title_key")).agg(F.count("*").alias("n")).where("n > 1")


@R.query(
    sql=f"""WITH {OBJ} SELECT derived_object_type, round(avg(confidence_score), 6) AS mean_score, CAST(count(*) AS BIGINT) AS n, CAST(count_if(object_status = 'active') AS BIGINT) AS n_active,
    round(100.0 * count(candidate_key) / count(*), 4) AS keyed_percent, CAST(count(DISTINCT artifact_id) AS BIGINT) AS n_artifacts FROM obj GROUP BY 1"""
)
def audit_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Averages, counts and coverage per kind of object."""
    o = archive.objects(spark, d)
    return o.groupBy("derived_object_type").agg(
        F.round(F.avg("confidence_score"), 6).alias("mean_score"), F.count("*").alias("n"), F.count_if(F.col("object_status") == "active").alias("n_active"),
        F.round(100.0 * F.count("candidate_key") / F.count("*"), 4).alias("keyed_percent"), F.count_distinct("artifact_id").alias("n_artifacts"),
    )


@R.query(
    sql=f"""WITH {OBJ}, r AS (SELECT derived_object_type, derived_object_id, confidence_score, row_number() OVER (PARTITION BY derived_object_type ORDER BY confidence_score, derived_object_id) AS rn FROM obj WHERE confidence_score IS NOT NULL)
    SELECT derived_object_type, derived_object_id, confidence_score FROM r WHERE rn <= 3"""
)
def worst_per_bucket(spark: SparkSession, d: str) -> DataFrame:
    """The three worst objects of each kind (the rank filter is pushed into the sort)."""
    w = Window.partitionBy("derived_object_type").orderBy("confidence_score", "derived_object_id")
    o = table(spark, d, "oa_derived_object").where("confidence_score is not null").select("derived_object_type", "derived_object_id", "confidence_score")
    return o.withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@R.query(
    sql=f"""WITH {OBJ}, k AS (SELECT artifact_id, derived_object_type FROM obj WHERE object_status = 'active' GROUP BY 1, 2)
    SELECT artifact_id FROM k GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT derived_object_type) FROM k)"""
)
def complete_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts with every kind of object: an intersection over all kinds."""
    k = table(spark, d, "oa_derived_object").where("object_status = 'active'").select("artifact_id", "derived_object_type").distinct()
    kinds = k.agg(F.count_distinct("derived_object_type").alias("all_kinds"))
    return k.groupBy("artifact_id").agg(F.count("*").alias("kinds")).join(F.broadcast(kinds), F.col("kinds") == F.col("all_kinds")).select("artifact_id")


@R.query(
    sql=f"""WITH {OBJ} SELECT artifact_id, CAST(coalesce(sum(CASE WHEN derived_object_type = 'memory' THEN 1 END), 0) AS BIGINT) AS memory, CAST(coalesce(sum(CASE WHEN derived_object_type = 'entity' THEN 1 END), 0) AS BIGINT) AS entity,
    CAST(coalesce(sum(CASE WHEN derived_object_type = 'relationship' THEN 1 END), 0) AS BIGINT) AS relationship, CAST(coalesce(sum(CASE WHEN derived_object_type = 'summary' THEN 1 END), 0) AS BIGINT) AS summary,
    CAST(coalesce(sum(CASE WHEN derived_object_type = 'classification' THEN 1 END), 0) AS BIGINT) AS classification FROM obj GROUP BY 1"""
)
def kind_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Counts by kind as columns."""
    kinds = ["memory", "entity", "relationship", "summary", "classification"]
    return table(spark, d, "oa_derived_object").groupBy("artifact_id").pivot("derived_object_type", kinds).count().na.fill(0, kinds)


@R.query(
    sql=f"""WITH {SEG}, r AS (SELECT artifact_id, segment_id, row_number() OVER (PARTITION BY artifact_id ORDER BY sequence_no, segment_id) - 1 AS place FROM seg WHERE sequence_no IS NOT NULL)
    SELECT artifact_id, segment_id, CAST(place AS INTEGER) AS place FROM r WHERE place >= 5 AND place < 15"""
)
def segment_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of every artifact's first segments (the rank filter limits each group before the shuffle)."""
    s = archive.segments(spark, d, "artifact_id", "sequence_no").where("sequence_no is not null")
    w = Window.partitionBy("artifact_id").orderBy("sequence_no", "segment_id")
    return s.withColumn("place", F.row_number().over(w) - 1).where("place >= 5 and place < 15").select("artifact_id", "segment_id", "place")


@R.query(
    sql=f"""WITH {OBJ}, m AS (SELECT artifact_id, derived_object_type AS kind, count(*) AS n, avg(strlen(coalesce(body_text, ''))) AS mean_bytes, count_if(confidence_score >= 0.8) AS high FROM obj WHERE object_status = 'active' GROUP BY 1, 2),
    b AS (SELECT artifact_id, sum(n) AS n, max(CASE WHEN kind = 'summary' THEN mean_bytes END) AS summary_bytes, sum(high) AS high FROM m GROUP BY 1)
    SELECT artifact_id, CAST(CASE WHEN summary_bytes IS NULL THEN 0 WHEN summary_bytes < 40 THEN 5 WHEN summary_bytes < 400 THEN 20 ELSE 12 END + least(20, 4 * n) + CAST(round(10.0 * high / n) AS INTEGER) AS BIGINT) AS quality FROM b"""
)
def audit_scores(spark: SparkSession, d: str) -> DataFrame:
    """A banded quality score per artifact out of conditional aggregates, reduced per kind first."""
    o = table(spark, d, "oa_derived_object").where("object_status = 'active'")
    size = F.octet_length(F.coalesce("body_text", F.lit("")))
    kinds = o.groupBy("artifact_id", "derived_object_type").agg(F.count("*").alias("n"), F.avg(size).alias("mean_bytes"), F.count_if(F.col("confidence_score") >= 0.8).alias("high"))
    per = kinds.groupBy("artifact_id").agg(F.sum("n").alias("n"), F.max(F.when(F.col("derived_object_type") == "summary", F.col("mean_bytes"))).alias("bytes"), F.sum("high").alias("high"))
    band = F.when(F.col("bytes").isNull(), 0).when(F.col("bytes") < 40, 5).when(F.col("bytes") < 400, 20).otherwise(12)
    return per.select("artifact_id", (band + F.least(F.lit(20), 4 * F.col("n")) + F.round(10.0 * F.col("high") / F.col("n")).cast("int")).cast("long").alias("quality"))
