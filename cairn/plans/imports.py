"""Imports, notes, coverage, comparison and sampling queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators import enrich, graph, imports, retrieval
from cairn.plans.registry import Registry
from cairn.plans.relational import ART, OBJ, SEG
from cairn.sources import archive, exports, parsers
from cairn.tables import table

R = Registry()


@R.query(
    sql="""WITH a AS (SELECT 'doc-' || doc_id AS artifact_id, doc_id, source AS source_type, 'v1' AS hash_version, sha256(text) AS content_hash FROM documents),
    e AS (SELECT source_type, hash_version, content_hash, min(artifact_id) AS known FROM a WHERE doc_id % 2 = 0 GROUP BY 1, 2, 3), i AS (SELECT * FROM a WHERE doc_id % 2 = 1),
    p AS (SELECT i.*, e.known, min(i.artifact_id) OVER (PARTITION BY i.source_type, i.hash_version, i.content_hash) AS first_id FROM i LEFT JOIN e USING (source_type, hash_version, content_hash))
    SELECT artifact_id, CASE WHEN source_type IS NULL OR content_hash IS NULL THEN NULL ELSE coalesce(known, first_id) END AS final_id,
    CASE WHEN source_type IS NULL OR content_hash IS NULL THEN 'failed' WHEN known IS NOT NULL OR first_id <> artifact_id THEN 'already_exists' ELSE 'imported' END AS outcome FROM p"""
)
def import_plan(spark: SparkSession, d: str) -> DataFrame:
    """Odd documents imported over even ones."""
    a = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("artifact_id"), "doc_id", F.col("source").alias("source_type"), F.lit("v1").alias("hash_version"), F.sha2("text", 256).alias("content_hash"))
    planned = imports.plan_import(a.where("doc_id % 2 = 0"), a.where("doc_id % 2 = 1"))
    return planned.select("artifact_id", "final_id", "outcome")


@R.query(sql="WITH e AS (SELECT DISTINCT candidate_key, derived_object_type FROM oa_derived_object) SELECT o.derived_object_id, m.matched_id FROM oa_derived_object o LEFT JOIN (SELECT candidate_key, derived_object_type, min(derived_object_id) AS matched_id FROM oa_derived_object WHERE trim(coalesce(candidate_key, '')) <> '' AND derived_object_type IS NOT NULL GROUP BY 1, 2) m ON m.candidate_key = o.candidate_key AND m.derived_object_type = o.derived_object_type WHERE o.object_status = 'active'")
def candidate_match(spark: SparkSession, d: str) -> DataFrame:
    """Active objects with the first record of their kind and key."""
    o = table(spark, d, "oa_derived_object")
    return imports.first_match(o.where("object_status = 'active'"), o, ["candidate_key", "derived_object_type"], "derived_object_id").select("derived_object_id", "matched_id")


@R.query(
    sql=f"""WITH {OBJ}, l AS (SELECT artifact_id, derived_object_id, 'lexical' AS origin FROM obj WHERE contains(lower(coalesce(title, '')), 'retry')), s AS (SELECT artifact_id, derived_object_id, 'semantic' AS origin FROM obj WHERE derived_object_type = 'summary')
    SELECT * FROM l UNION ALL SELECT * FROM s WHERE artifact_id NOT IN (SELECT artifact_id FROM l WHERE artifact_id IS NOT NULL)"""
)
def semantic_supplement(spark: SparkSession, d: str) -> DataFrame:
    """Lexical hits, supplemented by hits in artifacts not found yet."""
    o = table(spark, d, "oa_derived_object").select("artifact_id", "derived_object_id", "title", "derived_object_type")
    lexical = o.where(F.lower(F.coalesce("title", F.lit(""))).contains("retry")).select("artifact_id", "derived_object_id", F.lit("lexical").alias("origin"))
    semantic = o.where("derived_object_type = 'summary'").select("artifact_id", "derived_object_id", F.lit("semantic").alias("origin"))
    return imports.append_unique(lexical, semantic, "artifact_id")


@R.query(
    sql=f"""WITH {ART}, want AS (SELECT artifact_id, 'markdown_file/en/' || (doc_id + 1) || '.md' AS target_path FROM art), own AS (SELECT path_key, min(artifact_id) AS resolved FROM art GROUP BY 1)
    SELECT w.artifact_id, w.target_path, CASE WHEN o.resolved <> w.artifact_id THEN o.resolved END AS resolved FROM want w LEFT JOIN own o ON o.path_key = w.target_path"""
)
def path_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Note links resolved by path, never to the note itself."""
    a = archive.artifacts(spark, d)
    wanted = a.select("artifact_id", F.concat(F.lit("markdown_file/en/"), F.col("doc_id") + 1, F.lit(".md")).alias("target_path"))
    owners = a.groupBy(F.col("path_key").alias("target_path")).agg(F.min("artifact_id").alias("resolved"))
    return wanted.join(owners, "target_path", "left").select("artifact_id", "target_path", F.when(F.col("resolved") != F.col("artifact_id"), F.col("resolved")).alias("resolved"))


@R.query(
    sql=f"""WITH {SEG}, w AS (SELECT artifact_id, sequence_no AS a, sequence_no + 4 AS b FROM seg WHERE segment_type = 'content_window' AND sequence_no IS NOT NULL)
    SELECT s.segment_id FROM seg s WHERE s.segment_type = 'content_block' AND NOT EXISTS (SELECT 1 FROM w WHERE w.artifact_id = s.artifact_id AND s.sequence_no BETWEEN w.a AND w.b)"""
)
def uncovered_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments outside every window, by the blocked range join."""
    from cairn.plans.relational import window_membership

    blocks = archive.segments(spark, d, "segment_type").where("segment_type = 'content_block'").select("segment_id")
    return blocks.join(window_membership(spark, d).select("segment_id").distinct(), "segment_id", "left_anti")


@R.query(
    sql="""SELECT record_id, array_to_string(list_transform(list_filter(chat_messages, lambda m: trim(coalesce(m.text, '')) <> ''), lambda m: '[' || coalesce(nullif(lower(m.sender), ''), 'unknown') || '] ' || m.text), chr(10) || chr(10)) AS transcript
    FROM claude_export WHERE chat_messages IS NOT NULL"""
)
def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """The rendered transcript of each conversation, from its own array."""
    raw = exports.read_paths(spark, d, "claude_export", ["record_id", "chat_messages.sender", "chat_messages.text"]).where("chat_messages is not null")
    said = F.filter("chat_messages", lambda m: F.trim(F.coalesce(m["text"], F.lit(""))) != "")
    line = lambda m: F.concat(F.lit("["), F.coalesce(F.nullif(F.lower(m["sender"]), F.lit("")), F.lit("unknown")), F.lit("] "), m["text"])
    return raw.select("record_id", F.array_join(F.transform(said, line), "\n\n").alias("transcript"))


@R.query(
    sql=f"""WITH {OBJ}, a AS (SELECT artifact_id, derived_object_id, CASE WHEN derived_object_type = 'summary' THEN true END AS s, row_number() OVER (PARTITION BY artifact_id ORDER BY confidence_score DESC NULLS LAST, derived_object_id) AS r FROM obj),
    b AS (SELECT artifact_id, derived_object_id, CASE WHEN derived_object_type = 'summary' THEN true END AS s, row_number() OVER (PARTITION BY artifact_id ORDER BY strlen(coalesce(body_text, '')) DESC, derived_object_id) AS r FROM obj),
    x AS (SELECT coalesce(p.artifact_id, q.artifact_id) AS artifact_id, CAST(count(*) FILTER (p.r IS NOT NULL AND q.r IS NOT NULL) AS DOUBLE) / count(*) AS overlap, max(CASE WHEN p.r = 1 AND q.r = 1 THEN 1.0 ELSE 0.0 END) AS top,
        CASE WHEN count(p.s) + count(q.s) > 0 THEN max(CASE WHEN p.s AND q.s THEN 1.0 ELSE 0.0 END) END AS summaries
        FROM (SELECT * FROM a WHERE r <= 3) p FULL JOIN (SELECT * FROM b WHERE r <= 3) q ON p.artifact_id = q.artifact_id AND p.derived_object_id = q.derived_object_id GROUP BY 1)
    SELECT round(avg(overlap), 6) AS mean_overlap, round(avg(top), 6) AS top_agreement, round(avg(summaries), 6) AS summary_agreement, CAST(count(*) AS BIGINT) AS n FROM x"""
)
def ranking_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two rankers compared: mean Jaccard overlap of their top three, agreement on the first, and on a summary among the three."""
    o = table(spark, d, "oa_derived_object").select("artifact_id", "derived_object_id", (F.col("derived_object_type") == "summary").alias("s"), "confidence_score", F.octet_length(F.coalesce("body_text", F.lit(""))).alias("size"))

    def top(order, name: str) -> DataFrame:
        w = Window.partitionBy("artifact_id").orderBy(order, "derived_object_id")
        return o.withColumn(name, F.row_number().over(w)).where(F.col(name) <= 3).select("artifact_id", "derived_object_id", "s", name)

    both = top(F.desc_nulls_last("confidence_score"), "p").join(top(F.desc("size"), "q"), ["artifact_id", "derived_object_id", "s"], "full_outer")
    shared = F.col("p").isNotNull() & F.col("q").isNotNull()
    per = both.groupBy("artifact_id").agg((F.count_if(F.col("p").isNotNull() & F.col("q").isNotNull()) / F.count("*")).alias("overlap"), F.max(F.when((F.col("p") == 1) & (F.col("q") == 1), 1.0).otherwise(0.0)).alias("top"), F.max(F.when(F.col("s"), F.when(shared, 1.0).otherwise(0.0))).alias("summaries"))
    return per.agg(F.round(F.avg("overlap"), 6).alias("mean_overlap"), F.round(F.avg("top"), 6).alias("top_agreement"), F.round(F.avg("summaries"), 6).alias("summary_agreement"), F.count("*").alias("n"))


@R.query(
    sql="""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.query_id, v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) AS sim FROM embeddings v, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rn FROM s)
    SELECT round(avg(CASE WHEN query_id = vec_id AND sim > 0.99 THEN 1.0 ELSE 0.0 END), 6) AS self_hit_rate, CAST(count(*) AS BIGINT) AS n FROM r WHERE rn = 1"""
)
def vector_self_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    """How often the nearest vector of a query is the query itself."""
    e = table(spark, d, "embeddings")
    # queries under other ids, so that a vector may find itself
    shifted = e.where("vec_id % 100 = 0").withColumn("vec_id", -F.col("vec_id") - 1)
    near = retrieval.batch_knn(e, shifted, "vec_id", "embedding", 1)
    hit = (F.col("vec_id") == -F.col("query_id") - 1) & (F.col("similarity") > 0.99)
    return near.agg(F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("self_hit_rate"), F.count("*").alias("n"))


@R.query(sql="SELECT event_type, min(event_id) AS first_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 40 = 0 GROUP BY 1")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    """A stride sample (sampling is the feature), summarised."""
    return table(spark, d, "events").where("event_id % 40 = 0").groupBy("event_type").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))


@R.query(sql="SELECT archive_link_id, 'artlink-backfill-' || left(md5(archive_link_id), 24) AS backfill_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00' AS created FROM oa_archive_link")
def backfill_ids(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic ids from a hash, and formatted times."""
    link = table(spark, d, "oa_archive_link")
    return link.select("archive_link_id", F.concat(F.lit("artlink-backfill-"), F.substring(F.md5("archive_link_id"), 1, 24)).alias("backfill_id"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSx").alias("created"))


@R.query(sql="SELECT event_id, epoch_us(make_timestamp(CAST(round(value * 1000000) AS BIGINT))) AS at_us FROM events")
def epoch_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Fractional epoch seconds as instants; not-a-number gives null."""
    micros = F.round(F.col("value") * 1_000_000)
    return table(spark, d, "events").select("event_id", F.unix_micros(F.timestamp_micros(F.when(~F.isnan("value"), micros).try_cast("long"))).alias("at_us"))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as notes of a vault, with front matter, tags and links made from their columns."""
    a = archive.artifacts(spark, d).where("body is not null and trim(body) <> ''")
    front = F.concat(F.lit("---\ntitle: "), F.coalesce("title", F.lit("untitled")), F.lit("\ntags: ["), "lang", F.lit(", Src/"), "source_type", F.lit("]\naliases: "), F.coalesce("account_key", F.lit("none")), F.lit("\nstatus: open\n---\n"))
    links = F.concat(F.lit("\n\n- see [[markdown_file/en/"), F.col("doc_id") + 1, F.lit(".md|next]] and [site](https://example.com/"), "doc_id", F.lit(") #Inbox/"), "lang", F.lit("\n"))
    return a.select("artifact_id", F.col("path_key").alias("path"), F.concat(front, "body", links).alias("text"))


@R.query()
def note_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Title, tags, aliases, properties and links of every note, nested."""
    schema = "artifact_id string, " + parsers.NOTE.replace("\n", " ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = parsers._frame([parsers.parse_note(p, t) for p, t in zip(batch["path"], batch["text"])])
            yield pd.concat([batch["artifact_id"].reset_index(drop=True), frame], axis=1)

    return _notes(spark, d).mapInPandas(run, schema)


def external_links(spark: SparkSession, d: str) -> DataFrame:
    """``(artifact_id, seq, external_url, display_text, raw_target)``: the links of all notes that lead outside."""
    links = note_metadata(spark, d).select("artifact_id", F.posexplode("links").alias("seq", "l")).where("l.target_kind = 'external'")
    return links.select("artifact_id", "seq", F.col("l.raw_target").alias("external_url"), "l.display_text", "l.raw_target")


@R.query()
def note_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of all notes with the artifact they resolve to: by path, else by a stem that only one note has."""
    links = note_metadata(spark, d).select("artifact_id", F.posexplode("links").alias("seq", "l")).select("artifact_id", "seq", "l.*")
    stem = lambda c: F.lower(F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"(?i)\.(?:md|markdown)$", ""))
    art = archive.artifacts(spark, d)
    owners = art.select(F.col("path_key").alias("target_path"), F.col("artifact_id").alias("by_path"))
    found = links.join(owners, "target_path", "left").withColumn("stem", F.when(F.col("target_kind").isin("note", "heading", "block") & F.col("by_path").isNull(), F.nullif(stem(F.col("target_path")), F.lit(""))))
    found = graph.resolve_unique(found, "stem", art.select(stem(F.col("path_key")).alias("name"), "artifact_id"), "name", "artifact_id")
    return found.select("artifact_id", "seq", "kind", "target_kind", "raw_target", F.coalesce("by_path", "resolved").alias("resolved"))


@R.query(
    sql=f"""WITH {ART}, n AS (SELECT artifact_id, doc_id FROM art WHERE trim(coalesce(body, '')) <> ''), l AS (SELECT n.artifact_id AS source, 'doc-' || (n.doc_id + 1) AS target FROM n WHERE n.doc_id + 1 IN (SELECT doc_id FROM art))
    SELECT target AS artifact_id, CAST(count(*) AS BIGINT) AS n_inbound, min(source) AS first_source FROM l GROUP BY 1"""
)
def note_inbound(spark: SparkSession, d: str) -> DataFrame:
    """Notes that others link to, with the number of links and the first note they come from."""
    links = note_links(spark, d).where("resolved is not null")
    return links.groupBy(F.col("resolved").alias("artifact_id")).agg(F.count("*").alias("n_inbound"), F.min("artifact_id").alias("first_source"))


@R.query()
def vault_statistics(spark: SparkSession, d: str) -> DataFrame:
    """What parsing the vaults gave: totals, links by kind of target, the twelve most linked targets, the ten most frequent attachment types."""
    links = note_metadata(spark, d).select(F.explode("links").alias("l")).select("l.*")
    notes = note_metadata(spark, d)
    part = lambda df, section, name: df.groupBy(F.lit(section).alias("section"), name.alias("name")).agg(F.count("*").alias("n"))
    top = lambda df, k: df.orderBy(F.desc("n"), "name").limit(k)
    kind = F.regexp_extract(F.lower("target_path"), r"\.([a-z0-9]+)$", 1)
    return (
        notes.agg(F.lit("total").alias("section"), F.lit("notes").alias("name"), F.count("*").alias("n"))
        .unionByName(notes.agg(F.lit("total").alias("section"), F.lit("tags").alias("name"), F.sum(F.size("tags")).alias("n")))
        .unionByName(notes.agg(F.lit("total").alias("section"), F.lit("errors").alias("name"), F.count("error").alias("n")))
        .unionByName(part(links, "target_kind", F.col("target_kind")))
        .unionByName(top(part(links, "target", F.col("raw_target")), 12))
        .unionByName(top(part(links.where("target_kind = 'attachment'"), "attachment", kind), 10))
    )


@R.query(
    sql=f"""WITH {SEG}, k AS (SELECT artifact_id, participant_id, segment_id, text_content AS t, strlen(text_content) AS b, segment_type FROM seg),
    r AS (SELECT *, row_number() OVER (PARTITION BY artifact_id, participant_id ORDER BY coalesce(b, -1) DESC, segment_id) AS rn FROM k),
    y AS (SELECT artifact_id, participant_id, segment_type, min(segment_id) AS o FROM k WHERE trim(coalesce(segment_type, '')) <> '' GROUP BY 1, 2, 3)
    SELECT r.artifact_id, r.participant_id, md5(max(CASE WHEN rn = 1 THEN t END)) AS digest, CAST(count(*) AS BIGINT) AS n_merged, CAST(max(b % 10) AS INTEGER) AS importance,
        (SELECT string_agg(trim(y.segment_type), ' ' ORDER BY y.o, y.segment_type) FROM y WHERE y.artifact_id = r.artifact_id AND y.participant_id = r.participant_id) AS summary
    FROM r WHERE r.artifact_id IS NOT NULL AND r.participant_id IS NOT NULL GROUP BY 1, 2"""
)
def chunk_merge(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of several chunks merged per key: the longest text, the largest importance, the distinct summaries."""
    s = archive.segments(spark, d, "artifact_id", "participant_id", "text_content", "segment_type").where("artifact_id is not null and participant_id is not null")
    outputs = s.select("artifact_id", "participant_id", "segment_id", "text_content", (F.octet_length("text_content") % 10).alias("importance"), F.col("segment_type").alias("summary"))
    merged = enrich.merge_outputs(outputs, ["artifact_id", "participant_id"], ["text_content"], "importance", "summary", "segment_id")
    return merged.select("artifact_id", "participant_id", F.md5("text_content").alias("digest"), "n_merged", "importance", "summary")
