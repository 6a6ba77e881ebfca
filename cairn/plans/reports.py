"""Reports over the archive: quality scores, dashboards, usage, write sets, replay and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import payload
from cairn.operators import enrich, imports, ranks, retrieval
from cairn.plans.registry import Registry
from cairn.plans.relational import ART, LNK, OBJ, SEG
from cairn.sources import archive, exports
from cairn.tables import table

R = Registry()

# How long a text is in characters, by band, and what that is worth.
RICH, SMALL, LARGE = 500, 400, 2000
GENERIC_CLASSES = ("planning", "architecture", "technical", "discussion", "work")


def _audit(spark: SparkSession, d: str) -> DataFrame:
    """The seven sub-scores of every artifact with objects, and what was noted about it.

    Objects are reduced per artifact and kind, titles per artifact and title, before anything is put
    together.
    """
    o = archive.objects(spark, d).where("object_status = 'active' and artifact_id is not null")
    chars = F.length(F.trim(F.coalesce("body_text", F.lit(""))))
    titled = F.length(F.trim(F.coalesce("title", F.lit("")))) > 0
    kind = lambda k: F.col("derived_object_type") == k
    generic = F.lower(F.trim(F.get_json_object("object_json", "$.classification_value"))).isin(*GENERIC_CLASSES)
    base = o.groupBy("artifact_id").agg(
        F.count("*").alias("n"), F.count_if(kind("summary")).alias("n_sum"), F.count_if(kind("memory")).alias("n_mem"), F.count_if(kind("classification")).alias("n_cls"),
        F.count_if(kind("entity")).alias("n_ent"), F.count_if(kind("relationship")).alias("n_rel"), F.count_if(kind("memory") & (chars >= 40)).alias("n_useful"), F.count_if(kind("classification") & generic).alias("n_generic"),
        F.min_by(F.struct(chars.alias("chars"), titled.alias("titled")), F.when(kind("summary"), F.col("derived_object_id"))).alias("first"),
        F.count_distinct(F.when(kind("memory"), F.get_json_object("object_json", "$.memory_type"))).alias("n_types"),
        F.count_if(kind("memory") & F.get_json_object("object_json", "$.memory_type").isin("personal_fact", "ongoing_state")).alias("n_facts"),
    )
    key = F.lower(F.trim("title"))
    titles = o.where(kind("memory") & (key != "")).groupBy("artifact_id", key.alias("t")).agg(F.count("*").alias("c"))
    often = titles.groupBy("t").agg(F.sum("c").alias("everywhere"))
    repeats = titles.join(often, "t").groupBy("artifact_id").agg(F.sum(2 * (F.col("c") - 1)).alias("again"), F.count_if(F.col("everywhere") >= 4).alias("spread"))
    size = archive.segments(spark, d, "artifact_id", "text_content").groupBy("artifact_id").agg(F.sum(F.length(F.coalesce("text_content", F.lit("")))).alias("source_chars"))
    a = base.join(size, "artifact_id", "left").join(repeats, "artifact_id", "left").na.fill(0, ["source_chars", "again", "spread"])
    return a.withColumn("importance", importance(F.col("n_mem"), F.col("n_ent"), F.col("n_rel"), F.col("n_cls"), F.col("n_facts")))


def importance(n_mem: Column, n_ent: Column, n_rel: Column, n_cls: Column, n_facts: Column) -> Column:
    """How much an artifact's objects suggest that it matters: 2, 5, 6 or 7."""
    return F.when(n_mem + n_ent + n_rel + n_cls == 0, 2).when(n_facts > 0, 7).when((n_mem >= 4) | (n_rel > 0), 6).otherwise(5)


def _scores(a: DataFrame) -> DataFrame:
    c = F.col
    clamp = lambda x, top: F.least(F.greatest(x, F.lit(0.0)), F.lit(float(top)))
    chars, titled = F.coalesce("first.chars", F.lit(0)), F.coalesce("first.titled", F.lit(False))
    ratio = chars / F.greatest("source_chars", F.lit(1))
    summary = 10.0 + F.when(titled, 5.0).otherwise(0.0) + F.when(chars >= 80, 5.0).when(chars >= 30, 2.5).otherwise(0.0) - F.when((c("source_chars") > 0) & (chars > c("source_chars")), 4.0).otherwise(0.0)
    variety = F.when((c("n_types") == 1) & (c("n_mem") >= 3), -2.0).when(c("n_types") >= 2, 1.0).otherwise(0.0)
    memory = 6.0 + F.when(c("n_mem") <= 5, 4.0).otherwise(0.0) + 5.0 * c("n_useful") / c("n_mem") + variety
    classes = 5.0 + F.when((c("n_cls") == 0) & (c("source_chars") < SMALL), 2.0).otherwise(0.0) - F.when(c("n_cls") == 2, 1.0).otherwise(0.0) - 2.0 * c("n_generic")
    worth = 10.0 - F.when((c("source_chars") < SMALL) & (c("importance") > 6), 3.0).otherwise(0.0) - F.when((c("source_chars") > LARGE) & (c("importance") < 3), 2.0).otherwise(0.0)
    parts = {
        "summary_score": F.when(c("n_sum") == 0, 0.0).otherwise(clamp(summary, 20)),
        "evidence_score": F.lit(20.0),  # every stored object counts one piece of evidence
        "memory_score": F.when(c("n_mem") == 0, F.when(c("source_chars") >= RICH, 2.0).otherwise(8.0)).otherwise(clamp(memory, 15)),
        "classification_score": F.when(c("n_cls") > 2, 0.0).otherwise(clamp(classes, 10)),
        "compression_score": F.when((c("n_sum") == 0) | (chars == 0), 0.0).when(ratio.between(0.03, 0.35), 10.0).when(ratio < 0.03, 6.0).when(ratio <= 0.5, 7.0).otherwise(3.0),
        "importance_score": clamp(worth, 10),
        "duplicate_penalty": clamp((c("again") + c("spread")).cast("double"), 5),
    }
    scored = a.select("*", *(p.alias(n) for n, p in parts.items()))
    positive = reduce(lambda x, y: x + y, (c(n) for n in parts if n != "duplicate_penalty"))
    issues = {
        "missing_summary": c("n_sum") == 0, "multiple_summaries": c("n_sum") > 1, "empty_summary_title": (c("n_sum") > 0) & ~titled,
        "short_summary": (c("n_sum") > 0) & (chars >= 30) & (chars < 80), "tiny_summary": (c("n_sum") > 0) & (chars < 30),
        "no_memories_on_rich_artifact": (c("n_mem") == 0) & (c("source_chars") >= RICH), "too_many_memories": c("n_mem") > 5,
        "memory_type_monoculture": (c("n_types") == 1) & (c("n_mem") >= 3), "too_many_classifications": c("n_cls") > 2, "memory_title_repeated": c("again") > 0,
    }
    noted = F.array_compact(F.array(*(F.when(test, name) for name, test in issues.items())))
    return scored.withColumn("total", clamp(positive - c("duplicate_penalty"), 100)).withColumn("issues", noted)


_AUDIT_SQL = f"""WITH {SEG}, {OBJ}, o AS (SELECT *, length(trim(coalesce(body_text, ''))) AS chars, length(trim(coalesce(title, ''))) > 0 AS titled, json_extract_string(object_json, '$.memory_type') AS mt, lower(trim(json_extract_string(object_json, '$.classification_value'))) AS cv
    FROM obj WHERE object_status = 'active' AND artifact_id IS NOT NULL),
    b AS (SELECT artifact_id, count(*) AS n, count_if(derived_object_type = 'summary') AS n_sum, count_if(derived_object_type = 'memory') AS n_mem, count_if(derived_object_type = 'classification') AS n_cls, count_if(derived_object_type = 'entity') AS n_ent,
        count_if(derived_object_type = 'relationship') AS n_rel, count_if(derived_object_type = 'memory' AND chars >= 40) AS n_useful, count_if(derived_object_type = 'classification' AND cv IN ('planning', 'architecture', 'technical', 'discussion', 'work')) AS n_generic,
        coalesce(arg_min(chars, derived_object_id) FILTER (derived_object_type = 'summary'), 0) AS chars, coalesce(arg_min(titled, derived_object_id) FILTER (derived_object_type = 'summary'), false) AS titled,
        count(DISTINCT CASE WHEN derived_object_type = 'memory' THEN mt END) AS n_types, count_if(derived_object_type = 'memory' AND mt IN ('personal_fact', 'ongoing_state')) AS n_facts FROM o GROUP BY 1),
    t AS (SELECT artifact_id, lower(trim(title)) AS t, count(*) AS c FROM o WHERE derived_object_type = 'memory' AND lower(trim(title)) <> '' GROUP BY 1, 2), e AS (SELECT t, sum(c) AS everywhere FROM t GROUP BY 1),
    r AS (SELECT artifact_id, sum(2 * (c - 1)) AS again, count_if(everywhere >= 4) AS spread FROM t JOIN e USING (t) GROUP BY 1),
    z AS (SELECT artifact_id, sum(length(coalesce(text_content, ''))) AS source_chars FROM seg GROUP BY 1),
    a AS (SELECT b.*, coalesce(z.source_chars, 0) AS sc, coalesce(r.again, 0) AS again, coalesce(r.spread, 0) AS spread, CASE WHEN n_mem + n_ent + n_rel + n_cls = 0 THEN 2 WHEN n_facts > 0 THEN 7 WHEN n_mem >= 4 OR n_rel > 0 THEN 6 ELSE 5 END AS importance
        FROM b LEFT JOIN z USING (artifact_id) LEFT JOIN r USING (artifact_id)),
    p AS (SELECT *, chars * 1.0::DOUBLE / greatest(sc, 1) AS ratio FROM a),
    s AS (SELECT artifact_id, n, importance,
        CASE WHEN n_sum = 0 THEN 0.0 ELSE greatest(0.0, least(20.0, 10.0 + CASE WHEN titled THEN 5.0 ELSE 0.0 END + CASE WHEN chars >= 80 THEN 5.0 WHEN chars >= 30 THEN 2.5 ELSE 0.0 END - CASE WHEN sc > 0 AND chars > sc THEN 4.0 ELSE 0.0 END)) END::DOUBLE AS summary_score,
        20.0::DOUBLE AS evidence_score,
        CASE WHEN n_mem = 0 THEN CASE WHEN sc >= 500 THEN 2.0 ELSE 8.0 END ELSE greatest(0.0, least(15.0, 6.0 + CASE WHEN n_mem <= 5 THEN 4.0 ELSE 0.0 END + 5.0::DOUBLE * n_useful / n_mem + CASE WHEN n_types = 1 AND n_mem >= 3 THEN -2.0 WHEN n_types >= 2 THEN 1.0 ELSE 0.0 END)) END::DOUBLE AS memory_score,
        CASE WHEN n_cls > 2 THEN 0.0 ELSE greatest(0.0, least(10.0, 5.0 + CASE WHEN n_cls = 0 AND sc < 400 THEN 2.0 ELSE 0.0 END - CASE WHEN n_cls = 2 THEN 1.0 ELSE 0.0 END - 2.0 * n_generic)) END::DOUBLE AS classification_score,
        CASE WHEN n_sum = 0 OR chars = 0 THEN 0.0 WHEN ratio BETWEEN 0.03 AND 0.35 THEN 10.0 WHEN ratio < 0.03 THEN 6.0 WHEN ratio <= 0.5 THEN 7.0 ELSE 3.0 END::DOUBLE AS compression_score,
        greatest(0.0, least(10.0, 10.0 - CASE WHEN sc < 400 AND importance > 6 THEN 3.0 ELSE 0.0 END - CASE WHEN sc > 2000 AND importance < 3 THEN 2.0 ELSE 0.0 END))::DOUBLE AS importance_score,
        greatest(0.0, least(5.0, again + spread))::DOUBLE AS duplicate_penalty,
        list_filter([CASE WHEN n_sum = 0 THEN 'missing_summary' END, CASE WHEN n_sum > 1 THEN 'multiple_summaries' END, CASE WHEN n_sum > 0 AND NOT titled THEN 'empty_summary_title' END, CASE WHEN n_sum > 0 AND chars >= 30 AND chars < 80 THEN 'short_summary' END,
            CASE WHEN n_sum > 0 AND chars < 30 THEN 'tiny_summary' END, CASE WHEN n_mem = 0 AND sc >= 500 THEN 'no_memories_on_rich_artifact' END, CASE WHEN n_mem > 5 THEN 'too_many_memories' END, CASE WHEN n_types = 1 AND n_mem >= 3 THEN 'memory_type_monoculture' END,
            CASE WHEN n_cls > 2 THEN 'too_many_classifications' END, CASE WHEN again > 0 THEN 'memory_title_repeated' END], lambda x: x IS NOT NULL) AS issues FROM p),
    f AS (SELECT *, greatest(0, least(100, summary_score + evidence_score + memory_score + classification_score + compression_score + importance_score - duplicate_penalty)) AS total FROM s)"""
_PARTS = ("summary_score", "evidence_score", "memory_score", "classification_score", "compression_score", "importance_score", "duplicate_penalty", "total")


@R.query(sql=f"{_AUDIT_SQL} SELECT artifact_id, {', '.join(f'round({p}, 4) AS {p}' for p in _PARTS)} FROM f")
def audit_subscores(spark: SparkSession, d: str) -> DataFrame:
    """The quality score of every artifact and its seven parts."""
    return _scores(_audit(spark, d)).select("artifact_id", *(F.round(p, 4).alias(p) for p in _PARTS))


@R.query(sql=f"{_AUDIT_SQL} SELECT CAST(importance AS INTEGER) AS importance, CAST(count(*) AS BIGINT) AS n_artifacts, CAST(sum(n) AS BIGINT) AS n_objects, {', '.join(f'round(avg({p}), 4) AS {p}' for p in _PARTS)} FROM f GROUP BY 1")
def audit_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of the sub-scores by importance."""
    s = _scores(_audit(spark, d))
    return s.groupBy("importance").agg(F.count("*").alias("n_artifacts"), F.sum("n").alias("n_objects"), *(F.round(F.avg(p), 4).alias(p) for p in _PARTS))


@R.query(sql=f"{_AUDIT_SQL}, i AS (SELECT importance, unnest(issues) AS issue FROM f), c AS (SELECT importance, issue, count(*) AS n, row_number() OVER (PARTITION BY importance ORDER BY count(*) DESC, issue) AS rn FROM i GROUP BY 1, 2) SELECT CAST(importance AS INTEGER) AS importance, issue, CAST(n AS BIGINT) AS n FROM c WHERE rn <= 6")
def audit_issues(spark: SparkSession, d: str) -> DataFrame:
    """The six most frequent issues by importance."""
    c = _scores(_audit(spark, d)).select("importance", F.explode("issues").alias("issue")).groupBy("importance", "issue").agg(F.count("*").alias("n"))
    w = Window.partitionBy("importance").orderBy(F.desc("n"), "issue")
    return c.withColumn("rn", F.row_number().over(w)).where("rn <= 6").drop("rn")


@R.query(
    sql=f"""WITH {ART}, j AS (SELECT CASE event_id % 3 WHEN 0 THEN 'artifact_extract' WHEN 1 THEN 'artifact_reconcile' ELSE 'object_embedding' END AS t, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'retryable' ELSE 'failed' END AS s, event_id, ts FROM events)
    SELECT 'imports' AS section, CAST(batch_no AS VARCHAR) AS name, '' AS status, CAST(count(*) AS BIGINT) AS n FROM claude_export GROUP BY 2
    UNION ALL SELECT 'artifacts', enrichment_status, '', count(*) FROM art GROUP BY 2
    UNION ALL SELECT 'jobs', t, s, count(*) FROM j GROUP BY 2, 3
    UNION ALL SELECT 'embeddings', CAST(label AS VARCHAR), '', count(*) FROM embeddings GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'failures', 'job-' || event_id, s, epoch_us(ts) FROM j WHERE s = 'failed' ORDER BY ts DESC, event_id DESC LIMIT 10)"""
)
def pipeline_status(spark: SparkSession, d: str) -> DataFrame:
    """The dashboard: imports, artifacts, jobs and embeddings by status, and the last ten failures with their times."""
    jobs = archive.jobs(spark, d)
    none = F.lit("")
    counts = lambda df, section, name, status=none: df.groupBy(F.lit(section).alias("section"), name.cast("string").alias("name"), status.alias("status")).agg(F.count("*").alias("n"))
    last = jobs.where("job_status = 'failed'").orderBy(F.desc("available_us"), F.desc(F.substring("job_id", 5, 20).cast("long"))).limit(10)
    parts = [
        counts(table(spark, d, "claude_export").select("batch_no"), "imports", F.col("batch_no")),
        counts(archive.artifacts(spark, d), "artifacts", F.col("enrichment_status")),
        counts(jobs, "jobs", F.col("job_type"), F.col("job_status")),
        counts(table(spark, d, "embeddings"), "embeddings", F.col("label")),
        last.select(F.lit("failures").alias("section"), F.col("job_id").alias("name"), F.col("job_status").alias("status"), F.col("available_us").alias("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


@R.query(
    sql=f"""WITH {SEG}, {OBJ}, {LNK}, o AS (SELECT artifact_id, count_if(object_status = 'active') AS n_active, count_if(object_status = 'superseded') AS n_superseded, count_if(object_status = 'failed') AS n_failed,
        count_if(object_status NOT IN ('active', 'superseded', 'failed') OR object_status IS NULL) AS n_other, count(candidate_key) AS n_keyed, count(DISTINCT derivation_run_id) AS n_runs FROM obj WHERE artifact_id IS NOT NULL GROUP BY 1),
    s AS (SELECT artifact_id, count(*) AS n FROM seg GROUP BY 1), l AS (SELECT b.artifact_id, count(*) AS n FROM lnk JOIN obj b ON b.derived_object_id = lnk.target_object_id GROUP BY 1)
    SELECT artifact_id, CAST(n_active AS BIGINT) AS n_active, CAST(n_superseded AS BIGINT) AS n_superseded, CAST(n_failed AS BIGINT) AS n_failed, CAST(n_other AS BIGINT) AS n_other, CAST(n_keyed AS BIGINT) AS n_keyed, CAST(n_runs AS BIGINT) AS n_runs,
        CAST(coalesce(s.n, 0) AS BIGINT) AS n_segments, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links FROM o LEFT JOIN s USING (artifact_id) LEFT JOIN l USING (artifact_id)"""
)
def artifact_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Eight counts of every artifact: objects by status in one pass, runs, and two aggregates joined on."""
    o = archive.objects(spark, d)
    is_ = lambda s: F.col("object_status") == s
    counts = o.where("artifact_id is not null").groupBy("artifact_id").agg(
        *(F.count_if(is_(s)).alias(f"n_{s}") for s in ("active", "superseded", "failed")),
        F.count_if(F.coalesce(~F.col("object_status").isin("active", "superseded", "failed"), F.lit(True))).alias("n_other"), F.count("candidate_key").alias("n_keyed"), F.count_distinct("derivation_run_id").alias("n_runs"),
    )
    segments = archive.segments(spark, d, "artifact_id").groupBy("artifact_id").agg(F.count("*").alias("n_segments"))
    ends = archive.links(spark, d).groupBy(F.col("target_object_id").alias("derived_object_id")).count()
    links = ends.join(o.select("derived_object_id", "artifact_id"), "derived_object_id").groupBy("artifact_id").agg(F.sum("count").alias("n_links"))
    return counts.join(segments, "artifact_id", "left").join(links, "artifact_id", "left").na.fill(0, ["n_segments", "n_links"])


@R.query(sql="WITH a AS (SELECT user_id, count_if(event_type IN ('signup', 'view', 'purchase')) AS n, max(event_id) AS last_id FROM events GROUP BY 1) SELECT user_id, CAST(last_id AS BIGINT) AS last_id FROM a WHERE n <= 2")
def guarded_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts with two unfinished jobs at most: what a guard lets through, counted set-wise."""
    open_ = F.col("event_type").isin("signup", "view", "purchase")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(open_).alias("n"), F.max("event_id").alias("last_id")).where("n <= 2").select("user_id", "last_id")


@R.query(
    sql="""WITH j AS (SELECT event_id // 50 AS batch_no, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'view')
    SELECT batch_no, CAST(count(*) AS BIGINT) AS n_jobs, string_agg(k || ':job-' || event_id, ' ' ORDER BY k, event_id) AS jobs FROM j GROUP BY 1"""
)
def running_batches(spark: SparkSession, d: str) -> DataFrame:
    """Running jobs as an ordered list in their batch (a batch holds fifty jobs at most)."""
    j = archive.jobs(spark, d).where("job_status = 'running'").select("job_id", "priority_no", F.substring("job_id", 5, 20).cast("long").alias("event_id"))
    listed = F.array_sort(F.collect_list(F.struct("priority_no", "event_id", "job_id")))
    return j.groupBy(F.expr("event_id div 50").alias("batch_no")).agg(F.count("*").alias("n_jobs"), F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["priority_no"], x["job_id"])), " ").alias("jobs"))


@R.query(
    sql=f"""WITH {SEG}, {OBJ}, z AS (SELECT artifact_id, sum(length(coalesce(text_content, ''))) AS source_chars FROM seg GROUP BY 1), r AS (SELECT derivation_run_id, artifact_id, count(*) AS n_objects FROM obj WHERE derivation_run_id IS NOT NULL GROUP BY 1, 2)
    SELECT derivation_run_id, artifact_id, CAST(n_objects AS BIGINT) AS n_objects, CAST(source_chars AS BIGINT) AS source_chars FROM r JOIN z USING (artifact_id)"""
)
def runs_with_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Runs with the size of the artifacts that they were made from."""
    size = archive.segments(spark, d, "artifact_id", "text_content").groupBy("artifact_id").agg(F.sum(F.length(F.coalesce("text_content", F.lit("")))).alias("source_chars"))
    runs = archive.objects(spark, d).where("derivation_run_id is not null").groupBy("derivation_run_id", "artifact_id").agg(F.count("*").alias("n_objects"))
    return runs.join(size, "artifact_id").select("derivation_run_id", "artifact_id", "n_objects", "source_chars")


@R.query(sql="SELECT coalesce(account_tz, '') AS account, arg_max(record_id, (received_at, record_id)) AS record_id, epoch_us(max(received_at)) AS received_us FROM claude_export GROUP BY 1")
def latest_import(spark: SparkSession, d: str) -> DataFrame:
    """The latest import of every account."""
    e = table(spark, d, "claude_export")
    return e.groupBy(F.coalesce("account_tz", F.lit("")).alias("account")).agg(F.max_by("record_id", F.struct("received_at", "record_id")).alias("record_id"), F.unix_micros(F.max("received_at")).alias("received_us"))


@R.query(
    sql="""WITH u AS (SELECT user_id, CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS input_tokens, CASE WHEN event_id % 6 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 END AS output_tokens FROM events)
    SELECT user_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(coalesce(input_tokens + output_tokens, input_tokens, output_tokens)) AS BIGINT) AS total_tokens FROM u GROUP BY 1"""
)
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    """Token usage normalised over providers and summed; what nobody reported stays null."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    told = F.when(F.col("event_id") % 4 != 0, k), F.when(F.col("event_id") % 6 == 0, k * 2)
    # two providers name their counts differently
    body = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(told[0].alias("prompt_tokens"), told[1].alias("completion_tokens")))).otherwise(F.to_json(F.struct(told[0].alias("promptTokenCount"), told[1].alias("candidatesTokenCount"))))
    u = e.select("user_id", payload.usage(body).alias("u"))
    return u.groupBy("user_id").agg(*(F.sum(f"u.{n}").alias(n) for n in ("input_tokens", "output_tokens", "total_tokens")))


@R.query(
    sql="""WITH q AS (SELECT vec_id AS query_id, label, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT q.query_id, q.label, max(greatest(0, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])))) AS best FROM embeddings v JOIN q ON v.label = q.label AND v.vec_id <> q.query_id GROUP BY 1, 2)
    SELECT label, CAST(count(*) AS BIGINT) AS n, round(100.0 * count_if(best >= 0.5) / count(*), 3) AS attach_percent, round(median(best), 5) AS median_similarity FROM s GROUP BY 1"""
)
def reconcile_slices(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: how many would attach to their nearest neighbour, and the exact median of its similarity."""
    e = table(spark, d, "embeddings")
    best = retrieval.batch_knn(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 1, "label").join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    middle = ranks.values_at(best, "label", "similarity", {"low": (0.5, lambda n: F.floor((n - 1) / 2)), "high": (0.5, lambda n: F.ceil((n - 1) / 2))})
    share = best.groupBy("label").agg(F.round(100.0 * F.count_if(F.col("similarity") >= 0.5) / F.count("*"), 3).alias("attach_percent"))
    return middle.join(share, "label").select("label", "n", "attach_percent", F.round((F.col("low") + F.col("high")) / 2, 5).alias("median_similarity"))


@R.query(
    sql=f"""WITH {OBJ}, d AS (SELECT derived_object_type AS kind, candidate_key AS key, arg_min(derived_object_id, (created_at, derived_object_id)) AS decision FROM obj WHERE object_status <> 'active' AND candidate_key IS NOT NULL GROUP BY 1, 2)
    SELECT o.derived_object_id, o.derived_object_type, d.decision FROM obj o LEFT JOIN d ON d.kind = o.derived_object_type AND d.key = o.candidate_key WHERE o.object_status = 'active' AND (d.decision IS NOT NULL OR o.derived_object_type <> 'relationship')"""
)
def decision_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first decision on every candidate's kind and key; relationships without one are dropped."""
    o = archive.objects(spark, d)
    decided = o.where("object_status <> 'active' and candidate_key is not null").groupBy("derived_object_type", "candidate_key").agg(F.min_by("derived_object_id", F.struct("created_at", "derived_object_id")).alias("decision"))
    found = o.where("object_status = 'active'").join(decided, ["derived_object_type", "candidate_key"], "left")
    return found.where("decision is not null or derived_object_type <> 'relationship'").select("derived_object_id", "derived_object_type", "decision")


@R.query(
    sql=f"""WITH {OBJ}, r AS (SELECT candidate_key, derived_object_id, coalesce(title, '') AS title, row_number() OVER (PARTITION BY candidate_key ORDER BY derived_object_id) AS rn, count(*) OVER (PARTITION BY candidate_key) AS n FROM obj WHERE object_status = 'active' AND candidate_key IS NOT NULL)
    SELECT candidate_key, CAST(any_value(n) AS BIGINT) AS n_options, to_json(list({{'id': derived_object_id, 'title': title}} ORDER BY rn))::VARCHAR AS options FROM r WHERE n > 1 AND rn <= 5 GROUP BY 1"""
)
def ambiguous_cases(spark: SparkSession, d: str) -> DataFrame:
    """Keys with several objects, the first five options as JSON."""
    o = archive.objects(spark, d).where("object_status = 'active' and candidate_key is not null").select("candidate_key", "derived_object_id", F.coalesce("title", F.lit("")).alias("title"))
    first = o.withColumn("rn", F.row_number().over(Window.partitionBy("candidate_key").orderBy("derived_object_id"))).where("rn <= 5")
    options = F.transform(F.array_sort(F.collect_list(F.struct("rn", "derived_object_id", "title"))), lambda x: F.struct(x["derived_object_id"].alias("id"), x["title"].alias("title")))
    listed = first.groupBy("candidate_key").agg(F.to_json(options).alias("options"))
    return o.groupBy("candidate_key").agg(F.count("*").alias("n_options")).where("n_options > 1").join(listed, "candidate_key")


@R.query(
    sql=f"""WITH {OBJ}, r AS (SELECT CASE derived_object_type WHEN 'memory' THEN 0 WHEN 'entity' THEN 1 ELSE 2 END AS kind_rank, derived_object_type AS kind, artifact_id, derived_object_id FROM obj WHERE object_status = 'active' AND derived_object_type IN ('memory', 'entity', 'relationship'))
    SELECT kind_rank, kind, artifact_id, derived_object_id, CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY kind_rank, derived_object_id) AS INTEGER) AS place FROM r QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY kind_rank, derived_object_id) <= 50"""
)
def candidate_list(spark: SparkSession, d: str) -> DataFrame:
    """Each artifact's first fifty candidates: memories, then entities, then relationships."""
    o = archive.objects(spark, d).where("object_status = 'active'")
    parts = [o.where(F.col("derived_object_type") == k).select(F.lit(i).alias("kind_rank"), F.lit(k).alias("kind"), "artifact_id", "derived_object_id") for i, k in enumerate(("memory", "entity", "relationship"))]
    w = Window.partitionBy("artifact_id").orderBy("kind_rank", "derived_object_id")
    return reduce(DataFrame.unionByName, parts).withColumn("place", F.row_number().over(w)).where("place <= 50")


@R.query(
    sql=f"""WITH {SEG}, z AS (SELECT artifact_id, count(*) AS n, sum(strlen(coalesce(text_content, '')) + 1) AS n_bytes, max(strlen(coalesce(text_content, ''))) AS largest FROM seg GROUP BY 1)
    SELECT artifact_id, CAST(n_bytes AS BIGINT) AS n_bytes, CASE WHEN n_bytes <= 12000 AND largest <= 8000 THEN 'batch' ELSE 'single' END AS route FROM z"""
)
def input_routes(spark: SparkSession, d: str) -> DataFrame:
    """The estimated input size of every artifact, and whether it may share a batch."""
    size = F.octet_length(F.coalesce("text_content", F.lit("")))
    s = archive.segments(spark, d, "artifact_id", "text_content").groupBy("artifact_id").agg(F.sum(size + 1).alias("n_bytes"), F.max(size).alias("largest"))
    return s.select("artifact_id", "n_bytes", F.when((F.col("n_bytes") <= 12_000) & (F.col("largest") <= 8_000), "batch").otherwise("single").alias("route"))


@R.query(sql="SELECT doc_id, CASE WHEN strlen(text) <= 32768 THEN md5(text) ELSE 'summary:' || CAST(strlen(text) AS VARCHAR) END AS result FROM documents WHERE text IS NOT NULL")
def inline_results(spark: SparkSession, d: str) -> DataFrame:
    """Results up to 32 KiB inline (here their digest), larger ones by their size only."""
    size = F.octet_length("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.when(size <= 32_768, F.md5("text")).otherwise(F.concat(F.lit("summary:"), size.cast("string"))).alias("result"))


# Class and media type of each source.
SOURCES = [
    ("chatgpt_export", "conversation", "application/json"), ("claude_export", "conversation", "application/json"), ("grok_export", "conversation", "application/json"), ("gemini_takeout", "conversation", "application/json"),
    ("text_file", "document", "text/plain"), ("markdown_file", "document", "text/markdown"), ("obsidian_vault", "document", "application/zip"),
]


@R.query(
    sql=f"""WITH {ART}, s(source_type, class, mime) AS (VALUES {', '.join(map(str, SOURCES))})
    SELECT coalesce(class, 'unknown') AS class, coalesce(mime, 'unknown') AS mime, CAST(count(*) AS BIGINT) AS n FROM art LEFT JOIN s USING (source_type) GROUP BY 1, 2"""
)
def source_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts by the class and media type of their source, from a dimension of seven rows."""
    s = spark.createDataFrame(SOURCES, "source_type string, class string, mime string")
    a = archive.artifacts(spark, d).join(F.broadcast(s), "source_type", "left")
    return a.groupBy(F.coalesce("class", F.lit("unknown")).alias("class"), F.coalesce("mime", F.lit("unknown")).alias("mime")).agg(F.count("*").alias("n"))


@R.query(sql="SELECT derived_object_id, object_json AS found FROM oa_derived_object WHERE object_json IS NOT NULL")
def json_salvage(spark: SparkSession, d: str) -> DataFrame:
    """Payloads found again in model answers: fenced, bare, or between words."""
    o = table(spark, d, "oa_derived_object").where("object_json is not null")
    n = F.pmod(F.xxhash64("derived_object_id"), F.lit(3))
    answer = F.when(n == 0, F.concat(F.lit("Here it is:\n```json\n"), "object_json", F.lit("\n```\nDone."))).when(n == 1, F.concat(F.lit("  "), "object_json", F.lit("\n"))).otherwise(F.concat(F.lit("The answer is "), "object_json", F.lit(" as asked.")))
    return o.select("derived_object_id", payload.salvaged(answer).alias("found"))


@R.query(
    sql="""SELECT doc_id, CASE WHEN length(title) > 80 THEN left(title, 80) || '...' ELSE title END AS short_title, CASE WHEN length(text) > 512 THEN left(text, 512) || '…' ELSE text END AS excerpt, CASE WHEN length(text) > 96 THEN left(text, 96) || '…' ELSE text END AS preview FROM documents"""
)
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Titles of 80 characters, bodies of 512, previews of 96."""
    cut = lambda c, n, mark: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(F.col(c))
    return table(spark, d, "documents").select("doc_id", cut("title", 80, "...").alias("short_title"), cut("text", 512, "…").alias("excerpt"), cut("text", 96, "…").alias("preview"))


@R.query(
    sql="""WITH h AS (SELECT derived_object_id, sha256(derived_object_id) AS h FROM oa_derived_object)
    SELECT derived_object_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS point_id FROM h"""
)
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    """The whole point identifier of every object."""
    return table(spark, d, "oa_derived_object").select("derived_object_id", payload.point_id(F.col("derived_object_id")).alias("point_id"))


@R.query(
    sql=f"""WITH {OBJ}, c AS (SELECT derived_object_id, CASE WHEN candidate_key IS NULL THEN 'rejected' ELSE 'superseded' END AS to_status, CASE WHEN candidate_key IS NOT NULL THEN 'new-' || derived_object_id END AS replacement FROM obj WHERE derived_object_type = 'memory')
    SELECT o.derived_object_id, CASE WHEN o.object_status = 'active' THEN c.to_status ELSE o.object_status END AS object_status, CASE WHEN o.object_status = 'active' THEN c.replacement END AS replacement, CASE WHEN o.object_status = 'active' THEN 'changed' ELSE 'not_active' END AS outcome FROM c JOIN obj o USING (derived_object_id)"""
)
def status_changes(spark: SparkSession, d: str) -> DataFrame:
    """Status changes with their outcome: active objects change, others are told as errors."""
    o = archive.objects(spark, d)
    to = F.when(F.col("candidate_key").isNull(), "rejected").otherwise("superseded")
    asked = o.where("derived_object_type = 'memory'").select("derived_object_id", to.alias("to_status"), F.when(F.col("candidate_key").isNotNull(), F.concat(F.lit("new-"), "derived_object_id")).alias("replacement"))
    return enrich.change_status(o, asked).select("derived_object_id", "object_status", "replacement", "outcome")


@R.query(
    sql=f"""WITH {OBJ}, m AS (SELECT DISTINCT artifact_id FROM obj WHERE derived_object_type = 'summary' AND artifact_id IS NOT NULL)
    SELECT artifact_id, 'agentrun-' || artifact_id AS derivation_run_id, 'memory' AS derived_object_type, 'active' AS object_status, 'note on ' || artifact_id AS title FROM m"""
)
def agent_writes(spark: SparkSession, d: str) -> DataFrame:
    """Memories written by an agent, each under a run of its own."""
    m = archive.objects(spark, d).where("derived_object_type = 'summary' and artifact_id is not null").select("artifact_id").distinct()
    written = enrich.agent_write(m.select(F.col("artifact_id").alias("write_id"), "artifact_id", F.concat(F.lit("note on "), "artifact_id").alias("title"), F.lit("memory").alias("derived_object_type")))
    return written.select("artifact_id", "derivation_run_id", "derived_object_type", "object_status", "title")


@R.query(
    sql="""WITH r AS (SELECT record_id, batch_no, uuid, (chat_messages IS NULL OR len(chat_messages) = 0 OR uuid IS NULL) AS bad, row_number() OVER (PARTITION BY uuid ORDER BY record_id) AS rn FROM claude_export),
    o AS (SELECT batch_no, CASE WHEN bad THEN 'failed' WHEN rn > 1 THEN 'already_exists' ELSE 'created' END AS outcome FROM (SELECT batch_no, bad, row_number() OVER (PARTITION BY uuid, bad ORDER BY record_id) AS rn FROM r))
    SELECT batch_no, CAST(count_if(outcome = 'created') AS BIGINT) AS n_created, CAST(count_if(outcome = 'already_exists') AS BIGINT) AS n_existing, CAST(count_if(outcome = 'failed') AS BIGINT) AS n_failed,
    CASE WHEN count_if(outcome = 'failed') = 0 THEN 'completed' WHEN count_if(outcome = 'failed') = count(*) THEN 'failed' ELSE 'completed_with_errors' END AS status FROM o GROUP BY 1"""
)
def import_write(spark: SparkSession, d: str) -> DataFrame:
    """Imports written as sets: what fails is set apart, what is there is kept, and every import gets its counts and status."""
    e = table(spark, d, "claude_export").select("record_id", "batch_no", "uuid", F.size("chat_messages").alias("n"))
    bad = F.col("uuid").isNull() | F.coalesce(F.col("n") <= 0, F.lit(True))
    return imports.write_outcomes(e.withColumn("error", F.when(bad, "empty or without an identifier")), "batch_no", "uuid", "record_id")


@R.query(
    sql=f"""WITH o AS (SELECT DISTINCT sha256(text) AS sha256, text FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, sha256, CAST(strlen(text) AS BIGINT) AS n_bytes FROM r JOIN o USING (sha256)"""
)
def import_replay(spark: SparkSession, d: str) -> DataFrame:
    """Stored payloads by content, replayed for every import that refers to them."""
    docs = table(spark, d, "documents").where("text is not null")
    stored = imports.payloads(docs, "text")
    refs = docs.select("doc_id", F.sha2("text", 256).alias("sha256"))
    return refs.join(stored, "sha256").select("doc_id", "sha256", F.octet_length("payload").cast("long").alias("n_bytes"))


@R.query(
    sql=f"""WITH {ART} SELECT account_key, path_key AS path, sha256(coalesce(body, '')) AS sha256, '{{"path":"' || path_key || '","sha256":"' || sha256(coalesce(body, '')) || '","bytes":' || strlen(coalesce(body, '')) || '}}' AS entry FROM art WHERE source_type IN ('obsidian_vault', 'markdown_file')"""
)
def vault_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of every vault, one entry a file; contents are stored apart, by their digest."""
    a = archive.artifacts(spark, d).where("source_type in ('obsidian_vault', 'markdown_file')")
    body = F.coalesce("body", F.lit(""))
    return imports.manifest(a.select("account_key", F.col("path_key").alias("path"), body.alias("content")), "account_key", "path", "content")


@R.query(sql=f"WITH {OBJ}, r AS (SELECT derived_object_id, row_number() OVER (ORDER BY derived_object_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT derived_object_id FROM obj)) SELECT derived_object_id, CAST(place AS BIGINT) AS place FROM r WHERE place % greatest(1, n // 25) = 0 AND place // greatest(1, n // 25) < 25")
def stride_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """Twenty-five objects at equal strides of their rank (a sampling operator)."""
    return imports.stride(archive.objects(spark, d).select("derived_object_id").distinct(), "derived_object_id", 25)


@R.query(
    sql="""WITH c AS (SELECT record_id, unnest(chat_messages) AS m FROM claude_export), p AS (SELECT record_id, unnest(m.content) AS x FROM c), a AS (SELECT record_id, unnest(m.attachments) AS x FROM c), f AS (SELECT record_id, unnest(m.files) AS x FROM c),
    g AS (SELECT record_id, unnest(responses).response.message AS t FROM grok_export), t AS (SELECT record_id, len(regexp_extract_all(t, '</?(grok|xai):[^>]*>')) AS n FROM g WHERE t IS NOT NULL),
    s AS (SELECT 'claude_export' AS source, record_id, coalesce(nullif(lower(trim(x.type)), ''), 'untyped') AS kind FROM p WHERE x IS NOT NULL AND coalesce(lower(trim(x.type)), '') <> 'text'
        UNION ALL SELECT 'claude_export', record_id, 'attachment' FROM a WHERE x IS NOT NULL UNION ALL SELECT 'claude_export', record_id, 'file' FROM f WHERE x IS NOT NULL
        UNION ALL SELECT 'gemini_export', record_id, 'attached_file' FROM (SELECT record_id, unnest(attached_files) AS x FROM gemini_export) WHERE x IS NOT NULL
        UNION ALL SELECT 'gemini_export', record_id, 'image' FROM gemini_export WHERE image_file IS NOT NULL)
    SELECT source, record_id, kind, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2, 3 UNION ALL SELECT 'grok_export', record_id, 'render_tag', CAST(sum(n) AS BIGINT) FROM t WHERE n > 0 GROUP BY 2"""
)
def skipped_content(spark: SparkSession, d: str) -> DataFrame:
    """What an import leaves out of the text, recorded by kind: typed parts, attachments, files, images, render tags."""
    claude = exports.claude_nodes(exports.read_paths(spark, d, "claude_export", ["record_id", *(f"chat_messages.{p}" for p in ("uuid", "text", "sender", "created_at", "updated_at", "content", "attachments", "files"))]))
    one = lambda df, source, kind: df.select(F.lit(source).alias("source"), "record_id", kind.alias("kind"), F.lit(1).cast("long").alias("n"))
    kind = F.lower(F.trim(F.coalesce("part_type", F.lit(""))))
    grok = exports.grok_nodes(table(spark, d, "grok_export"))["response"].where("message is not null")
    gemini = table(spark, d, "gemini_export")
    parts = [
        one(claude["part"].where(kind != "text"), "claude_export", F.coalesce(F.nullif(kind, F.lit("")), F.lit("untyped"))),
        one(claude["attachment"], "claude_export", F.lit("attachment")),
        one(claude["file"], "claude_export", F.lit("file")),
        one(exports.gemini_nodes(gemini)["attached_file"], "gemini_export", F.lit("attached_file")),
        one(gemini.where("image_file is not null"), "gemini_export", F.lit("image")),
        grok.select(F.lit("grok_export").alias("source"), "record_id", F.lit("render_tag").alias("kind"), F.regexp_count("message", F.lit(r"</?(?:grok|xai):[^>]*>")).cast("long").alias("n")).where("n > 0"),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("source", "record_id", "kind").agg(F.sum("n").alias("n"))


@R.query(
    sql=f"""WITH {OBJ}, d AS (SELECT derived_object_type AS kind, candidate_key AS key, arg_min({{'id': derived_object_id, 's': object_status}}, (created_at, derived_object_id)) AS x FROM obj WHERE object_status <> 'active' AND candidate_key IS NOT NULL GROUP BY 1, 2),
    e AS (SELECT o.derived_object_id AS source, d.x.id AS target, CASE d.x.s WHEN 'superseded' THEN 'continues' WHEN 'rejected' THEN 'contradicts' ELSE 'same_as' END AS link_type FROM obj o JOIN d ON d.kind = o.derived_object_type AND d.key = o.candidate_key WHERE o.object_status = 'active')
    SELECT source, target, min(link_type) AS link_type FROM e WHERE source <> target GROUP BY 1, 2"""
)
def derivation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that decisions give: attached objects are the same, superseding ones continue, contradicted ones contradict."""
    o = archive.objects(spark, d)
    decided = o.where("object_status <> 'active' and candidate_key is not null").groupBy("derived_object_type", "candidate_key").agg(F.min_by(F.struct("derived_object_id", "object_status"), F.struct("created_at", "derived_object_id")).alias("x"))
    kind = F.when(F.col("x.object_status") == "superseded", "continues").when(F.col("x.object_status") == "rejected", "contradicts").otherwise("same_as")
    e = o.where("object_status = 'active'").join(decided, ["derived_object_type", "candidate_key"]).select(F.col("derived_object_id").alias("source"), F.col("x.derived_object_id").alias("target"), kind.alias("link_type"))
    return e.where("source <> target").groupBy("source", "target").agg(F.min("link_type").alias("link_type"))


@R.query(
    sql=f"""WITH {OBJ}, t AS (SELECT DISTINCT derived_object_type AS kind, candidate_key AS key FROM obj WHERE object_status = 'active' AND candidate_key IS NOT NULL), d AS (SELECT derived_object_type AS kind, candidate_key AS key, count(*) AS n FROM obj WHERE object_status <> 'active' AND candidate_key IS NOT NULL GROUP BY 1, 2)
    SELECT coalesce(t.kind, d.kind) AS kind, CASE WHEN t.kind IS NULL THEN 'not_asked_for' WHEN d.n IS NULL THEN 'missing' WHEN d.n > 1 THEN 'several' ELSE 'one' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM t FULL JOIN d ON t.kind = d.kind AND t.key = d.key GROUP BY 1, 2"""
)
def decision_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether every candidate has exactly one decision, and every decision a candidate."""
    o = archive.objects(spark, d).where("candidate_key is not null")
    keys = ["derived_object_type", "candidate_key"]
    asked = o.where("object_status = 'active'").select(*keys).distinct().withColumn("asked", F.lit(True))
    told = o.where("object_status <> 'active'").groupBy(*keys).agg(F.count("*").alias("c"))
    verdict = F.when(F.col("asked").isNull(), "not_asked_for").when(F.col("c").isNull(), "missing").when(F.col("c") > 1, "several").otherwise("one")
    return asked.join(told, keys, "full_outer").groupBy(F.col("derived_object_type").alias("kind"), verdict.alias("verdict")).agg(F.count("*").alias("n"))


@R.query(
    sql=f"""WITH {SEG}, {OBJ}, a AS (SELECT artifact_id, epoch_us(max(created_at)) AS last_us, count(*) AS n FROM oa_segment GROUP BY 1),
    b AS (SELECT artifact_id, title, row_number() OVER (PARTITION BY artifact_id ORDER BY confidence_score DESC NULLS LAST, derived_object_id) AS rn FROM obj WHERE derived_object_type = 'summary' AND object_status = 'active')
    SELECT a.artifact_id, last_us, b.title AS summary_title FROM a LEFT JOIN b ON b.artifact_id = a.artifact_id AND rn = 1 ORDER BY last_us DESC, a.artifact_id LIMIT 100"""
)
def timeline_with_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The latest hundred artifacts with their best summary (the page is cut before the summaries are joined)."""
    from cairn.plans.relational import best_summary

    last = table(spark, d, "oa_segment").groupBy("artifact_id").agg(F.unix_micros(F.max("created_at")).alias("last_us"))
    page = last.orderBy(F.desc("last_us"), "artifact_id").limit(100)
    return page.join(best_summary(spark, d).select("artifact_id", "summary_title"), "artifact_id", "left").select("artifact_id", "last_us", "summary_title")


@R.query(
    sql=f"""WITH {OBJ}, sg AS (SELECT DISTINCT segment_id, artifact_id FROM oa_segment), ka AS (SELECT DISTINCT artifact_id FROM oa_segment),
    s AS (SELECT o.derived_object_id, o.artifact_id, CASE o.scope_type WHEN 'artifact' THEN coalesce(o.scope_id = o.artifact_id, false) WHEN 'segment' THEN EXISTS (SELECT 1 FROM sg WHERE sg.segment_id = o.scope_id AND sg.artifact_id = o.artifact_id) ELSE false END AS ok,
        EXISTS (SELECT 1 FROM ka WHERE ka.artifact_id = o.artifact_id) AS known FROM obj o),
    w AS (SELECT 'object' AS kind, 'unknown_artifact' AS error FROM s WHERE NOT known UNION ALL SELECT 'object', 'foreign_scope' FROM s WHERE NOT ok
        UNION ALL SELECT 'link', CASE WHEN NOT EXISTS (SELECT 1 FROM obj WHERE derived_object_id = source_object_id) OR NOT EXISTS (SELECT 1 FROM obj WHERE derived_object_id = target_object_id) THEN 'unknown_end' WHEN source_object_id = target_object_id THEN 'self_link' END FROM oa_archive_link)
    SELECT kind, error, CAST(count(*) AS BIGINT) AS n FROM w WHERE error IS NOT NULL GROUP BY 1, 2"""
)
def derivation_validation(spark: SparkSession, d: str) -> DataFrame:
    """What makes stored derivations invalid, counted by error."""
    objects = archive.objects(spark, d).select("derived_object_id", "artifact_id", "scope_type", "scope_id")
    links = table(spark, d, "oa_archive_link").select("archive_link_id", "source_object_id", "target_object_id")
    segments = table(spark, d, "oa_segment").select("segment_id", "artifact_id")
    return imports.validate_derivations(objects, segments, links).groupBy("kind", "error").agg(F.count("*").alias("n"))
