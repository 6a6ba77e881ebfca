"""Text functions, hashes, parsers, merges and upserts as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import hashing, text, vectors
from cairn.operators import enrich
from cairn.plans.registry import Registry
from cairn.plans.relational import ART, OBJ, SEG
from cairn.sources import archive, exports, parsers
from cairn.tables import table

R = Registry()


def _key(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


_SINGULAR = "CASE WHEN length(x) > 4 AND ends_with(x, 'ies') THEN left(x, length(x) - 3) || 'y' WHEN length(x) > 4 AND ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN left(x, length(x) - 1) ELSE x END"


def _merge(c: str) -> str:
    return f"array_to_string(list_transform(string_split({_key(f'coalesce({c}, {chr(39)}{chr(39)})')}, ' '), lambda x: {_SINGULAR}), ' ')"


def _tokens(c: str) -> str:
    return f"list_distinct(list_transform(list_filter(string_split({_key(f'coalesce({c}, {chr(39)}{chr(39)})')}, ' '), lambda x: x <> ''), lambda x: {_SINGULAR}))"


@R.query(sql=f"SELECT derived_object_id, {_key('title')} AS title_key, trim(lower(regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g'))) AS ascii_key, lower(trim(title)) AS phrase, {_merge('title')} AS merged FROM oa_derived_object")
def normalize_key(spark: SparkSession, d: str) -> DataFrame:
    """Four normal forms of a title."""
    t = F.col("title")
    return table(spark, d, "oa_derived_object").select("derived_object_id", text.key_text(t).alias("title_key"), text.ascii_text(t).alias("ascii_key"), text.phrase(t).alias("phrase"), text.merge_text(t).alias("merged"))


@R.query(
    sql=f"""WITH k AS (SELECT p_partkey, p_name, p_type, {_key('p_type')} AS kind, {_key('p_name')} AS name FROM part)
    SELECT p_partkey, 'entity:' || name || ':' || kind AS entity_key, CASE WHEN kind = '' THEN 'entity' ELSE replace(kind, ' ', '_') END AS canonical_type,
    name <> '' AND NOT starts_with(trim(p_name), '.') AND NOT contains(p_name, '/') AS kept FROM k"""
)
def entity_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys, canonical types and the stop rule for names."""
    p = table(spark, d, "part")
    n, k = F.col("p_name"), F.col("p_type")
    return p.select("p_partkey", hashing.entity_key(n, k).alias("entity_key"), text.entity_type(k).alias("canonical_type"), text.is_entity(n, k).alias("kept"))


@R.query(
    sql=f"""SELECT row_id, 'mem:' || left(sha256(concat_ws('|', {_key('memory_type')}, memory_scope, {_key("coalesce(memory_scope_value, '')")}, {_key("coalesce(title, '')")}, {_key("coalesce(body_text, '')")})), 32) AS memory_key,
    substr(sha256(coalesce(body_text, '')), 1, 8) AS point FROM durable_health_history WHERE memory_type IS NOT NULL AND memory_scope IS NOT NULL"""
)
def candidate_key_sha(spark: SparkSession, d: str) -> DataFrame:
    """Hashed candidate keys of memories, and the head of their point ids."""
    m = table(spark, d, "durable_health_history").where("memory_type is not null and memory_scope is not null")
    key = hashing.memory_key(F.col("memory_type"), F.col("memory_scope"), F.col("memory_scope_value"), F.col("title"), F.col("body_text"))
    return m.select("row_id", key.alias("memory_key"), F.substring(hashing.point_id(F.coalesce("body_text", F.lit(""))), 1, 8).alias("point"))


@R.query(
    sql="""SELECT record_id, sha256(array_to_string(list_transform(list_filter(chat_messages, lambda m: m IS NOT NULL), lambda m, i: (i - 1) || ':' || coalesce(lower(m.sender), '') || ':' || coalesce(m.created_at, '') || ':' || coalesce(m.text, '') || chr(10)), '')) AS content_hash
    FROM claude_export WHERE chat_messages IS NOT NULL"""
)
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """The content hash of each conversation, from its own array of messages (nothing is grouped)."""
    raw = exports.read_paths(spark, d, "claude_export", ["record_id", "chat_messages.sender", "chat_messages.created_at", "chat_messages.text"]).where("chat_messages is not null")
    turns = F.transform(F.filter("chat_messages", lambda m: m.isNotNull()), lambda m: F.struct(F.lower(m["sender"]).alias("role"), m["created_at"].alias("at"), m["text"].alias("text")))
    return raw.select("record_id", hashing.conversation_hash(turns).alias("content_hash"))


@R.query(
    sql=f"""WITH p AS (SELECT derived_object_id, title, body_text, {_merge('title')} AS x, {_merge('body_text')} AS y, {_tokens('title')} AS tx, {_tokens('body_text')} AS ty FROM oa_derived_object)
    SELECT derived_object_id, round(CASE WHEN x = '' OR y = '' THEN 0 WHEN contains(x, y) OR contains(y, x) THEN 1 ELSE CAST(len(list_intersect(tx, ty)) AS DOUBLE) / least(len(tx), len(ty)) END, 6) AS overlap,
    round(CASE WHEN len(tx) + len(ty) = 0 THEN 1 ELSE CAST(len(list_intersect(tx, ty)) AS DOUBLE) / len(list_distinct(list_concat(tx, ty))) END, 6) AS jaccard FROM p"""
)
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap and Jaccard of titles and bodies."""
    t, b = F.col("title"), F.col("body_text")
    return table(spark, d, "oa_derived_object").select("derived_object_id", F.round(text.overlap_score(t, b), 6).alias("overlap"), F.round(text.jaccard(text.tokens(t), text.tokens(b)), 6).alias("jaccard"))


@R.query(sql=f"WITH {ART} SELECT artifact_id, CASE WHEN length(title) > 40 THEN left(title, 40) || '...' ELSE title END AS short_title, regexp_extract(path_key, '^([^/]+)/', 1) AS folder, split_part(path_key, '/', 3) AS file_name, replace(split_part(path_key, '/', 3), '.md', '') AS stem FROM art")
def titles_and_paths(spark: SparkSession, d: str) -> DataFrame:
    """Shortened titles and the parts of note paths."""
    a = archive.artifacts(spark, d)
    name = F.split_part("path_key", F.lit("/"), F.lit(3))
    return a.select("artifact_id", text.shorten(F.col("title"), 40).alias("short_title"), F.regexp_extract("path_key", r"^([^/]+)/", 1).alias("folder"), name.alias("file_name"), F.replace(name, F.lit(".md"), F.lit("")).alias("stem"))


@R.query(
    sql="""WITH r AS (SELECT record_id, unnest(responses) AS x, generate_subscripts(responses, 1) - 1 AS i FROM grok_export)
    SELECT record_id, CAST(i AS INTEGER) AS i, trim(regexp_replace(x.response.message, '<(/?)(grok:render|xai:)[^>]*>', '', 'g')) AS bare,
    CASE lower(coalesce(x.response.sender, '')) WHEN 'human' THEN 'user' WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' WHEN 'tool' THEN 'tool' ELSE 'unknown' END AS role
    FROM r WHERE x.response.message IS NOT NULL"""
)
def render_tags(spark: SparkSession, d: str) -> DataFrame:
    """Responses without inline render tags, with roles."""
    r = table(spark, d, "grok_export").select("record_id", F.posexplode("responses").alias("i", "x")).where("x.response.message is not null")
    return r.select("record_id", "i", text.strip_render_tags(F.col("x.response.message")).alias("bare"), text.role(F.col("x.response.sender")).alias("role"))


@R.query(
    sql="""WITH m AS (SELECT record_id, uuid AS source_id, unnest(chat_messages) AS x, generate_subscripts(chat_messages, 1) - 1 AS i FROM claude_export),
    t AS (SELECT record_id, source_id, i, x.uuid AS node_id, x.sender AS sender, list_transform(list_filter(x.content, lambda p: p.type = 'text' AND trim(coalesce(p.text, '')) <> ''), lambda p: p.text) AS parts, x.text AS plain FROM m WHERE x IS NOT NULL),
    u AS (SELECT record_id, source_id, i, node_id, lower(coalesce(sender, '')) AS s, CASE WHEN len(coalesce(parts, [])) > 0 THEN array_to_string(parts, chr(10) || chr(10)) ELSE plain END AS message_text FROM t)
    SELECT record_id, source_id, CAST(i AS INTEGER) AS i, node_id, CASE s WHEN 'human' THEN 'user' WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' WHEN 'tool' THEN 'tool' ELSE 'unknown' END AS role, message_text
    FROM u WHERE trim(coalesce(message_text, '')) <> ''"""
)
def flat_chat_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the flat chat export with their effective text; silent messages are left out."""
    raw = exports.read_paths(spark, d, "claude_export", ["record_id", "uuid", *(f"chat_messages.{p}" for p in ("uuid", "text", "sender", "content.type", "content.text"))])
    x = raw.select("record_id", F.col("uuid").alias("source_id"), F.posexplode("chat_messages").alias("i", "x")).where("x is not null")
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    parts = F.transform(F.filter("x.content", lambda p: (p["type"] == "text") & full(p["text"])), lambda p: p["text"])
    message = F.when(F.size(F.coalesce(parts, F.array().cast("array<string>"))) > 0, F.array_join(parts, "\n\n")).otherwise(F.col("x.text"))
    return x.select("record_id", "source_id", "i", F.col("x.uuid").alias("node_id"), text.role(F.col("x.sender")).alias("role"), message.alias("message_text")).where(full(F.col("message_text")))


@R.query()
def activity_messages(spark: SparkSession, d: str) -> DataFrame:
    """Prompts and replies of the activity log: the prompt from the title, the reply from the HTML."""
    g = table(spark, d, "gemini_export").select("record_id", "title", "safe_html_item", "subtitles")
    html = F.array_join(F.transform(F.filter("safe_html_item", lambda h: h["html"].isNotNull()), lambda h: h["html"]), "<br><br>")
    reply = parsers.html_text(html)
    subtitles = F.array_join(F.transform(F.filter("subtitles", lambda s: s["name"].isNotNull() & s["url"].isNull()), lambda s: s["name"]), "\n")
    said = g.select("record_id", F.regexp_extract("title", r"^Prompted (.*)$", 1).alias("prompt"), F.coalesce(F.nullif(reply, F.lit("")), F.nullif(subtitles, F.lit(""))).alias("reply")).where("reply is not null")
    turns = F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), F.nullif("prompt", F.lit("")).alias("text")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("text")))
    return said.select("record_id", F.inline(turns)).where("text is not null")


@R.query()
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Every HTML fragment as text."""
    items = exports.gemini_nodes(table(spark, d, "gemini_export"))["html_item"]
    return items.where("html is not null").select("record_id", "position", parsers.html_text(F.col("html")).alias("text"))


@R.query(
    sql="""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents)
    SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS block_no, unnest(ps) AS block FROM b"""
)
def plain_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of all documents."""
    return parsers.plain_blocks(table(spark, d, "documents"), "doc_id", "text")


@R.query()
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Headings, lists, code and paragraphs of all documents with their heading path."""
    return parsers.markdown_table(table(spark, d, "documents"), "doc_id", "text")


@R.query(
    sql="""WITH t AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(title || ' #' || source || '/' || coalesce(lang, 'und') || ' (#' || upper(account_key) || ') x#' || source, '(?:^|[\\s(\\[{])(#[A-Za-z0-9_/-]+)', 1), lambda x: lower(ltrim(x, '#'))))) AS tag FROM documents WHERE title IS NOT NULL AND account_key IS NOT NULL)
    SELECT doc_id, tag FROM t"""
)
def tag_extract(spark: SparkSession, d: str) -> DataFrame:
    """Inline tags of lines made of a document's title, source, language and account, normalised."""
    g = table(spark, d, "documents").where("title is not null and account_key is not null")
    line = F.concat("title", F.lit(" #"), "source", F.lit("/"), F.coalesce("lang", F.lit("und")), F.lit(" (#"), F.upper("account_key"), F.lit(") x#"), "source")
    return g.select("doc_id", F.explode(text.inline_tags(line)).alias("tag"))


@R.query(
    sql="""WITH s AS (SELECT record_id, unnest(responses) AS r FROM grok_export), w AS (SELECT record_id, unnest(r.response.web_search_results) AS x FROM s)
    SELECT record_id, x.url AS url, regexp_extract(x.url, '^([a-z]+)://', 1) AS scheme, regexp_extract(x.url, '^[a-z]+://([^/]+)', 1) AS host FROM w WHERE x.url IS NOT NULL"""
)
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """Scheme and host of every result link."""
    w = table(spark, d, "grok_export").select("record_id", F.explode("responses").alias("r")).select("record_id", F.explode("r.response.web_search_results").alias("x")).where("x.url is not null")
    part = lambda p: F.try_parse_url("x.url", F.lit(p))
    return w.select("record_id", F.col("x.url").alias("url"), F.coalesce(part("PROTOCOL"), F.lit("")).alias("scheme"), F.coalesce(part("HOST"), F.lit("")).alias("host"))


@R.query(
    sql=f"""WITH RECURSIVE {SEG}, p AS (SELECT artifact_id, sequence_no, strlen(coalesce(text_content, '')) AS size, row_number() OVER (PARTITION BY artifact_id ORDER BY sequence_no, segment_id) - 1 AS pos FROM seg WHERE sequence_no IS NOT NULL),
    h AS (SELECT *, sum(size) OVER (PARTITION BY artifact_id ORDER BY pos) AS upto, count(*) OVER (PARTITION BY artifact_id) AS n FROM p),
    e AS (SELECT a.artifact_id, a.pos, a.n, max(b.pos) + 1 AS fin FROM h a JOIN h b ON b.artifact_id = a.artifact_id AND b.pos BETWEEN a.pos AND a.pos + 39 AND (b.pos = a.pos OR b.upto - a.upto + a.size <= 12000) GROUP BY 1, 2, 3),
    c AS (SELECT artifact_id, 0 AS chunk_no, pos, fin, n FROM e WHERE pos = 0 UNION ALL SELECT c.artifact_id, c.chunk_no + 1, e.pos, e.fin, e.n FROM c JOIN e ON e.artifact_id = c.artifact_id AND e.pos = greatest(c.pos + 1, c.fin - 2) WHERE c.fin < c.n)
    SELECT c.artifact_id, CAST(chunk_no AS INTEGER) AS chunk_no, a.sequence_no AS first_no, b.sequence_no AS last_no, CAST(c.fin - c.pos AS INTEGER) AS n_items, CAST(b.upto - a.upto + a.size AS BIGINT) AS n_bytes
    FROM c JOIN h a ON a.artifact_id = c.artifact_id AND a.pos = c.pos JOIN h b ON b.artifact_id = c.artifact_id AND b.pos = c.fin - 1"""
)
def greedy_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping chunks of every artifact's segments."""
    return enrich.chunks(archive.segments(spark, d, "artifact_id", "sequence_no", "text_content"))


@R.query()
def cluster_memories(spark: SparkSession, d: str) -> DataFrame:
    """Greedy clusters of each artifact's memories."""
    o = table(spark, d, "oa_derived_object").where("derived_object_type = 'memory'")
    return enrich.cluster(o, "artifact_id", "derived_object_id", text.merge_text(F.col("body_text")))


@R.query(
    sql=f"""WITH {OBJ}, k AS (SELECT candidate_key, title, body_text, derived_object_id, row_number() OVER (PARTITION BY candidate_key ORDER BY strlen(title) DESC NULLS LAST, derived_object_id) AS rt,
        row_number() OVER (PARTITION BY candidate_key ORDER BY strlen(body_text) DESC NULLS LAST, derived_object_id) AS rb FROM obj WHERE candidate_key IS NOT NULL)
    SELECT candidate_key, md5(max(CASE WHEN rt = 1 THEN title END)) AS title_digest, md5(max(CASE WHEN rb = 1 THEN body_text END)) AS body_digest, CAST(count(*) AS BIGINT) AS n_merged FROM k GROUP BY 1"""
)
def richer_merge(spark: SparkSession, d: str) -> DataFrame:
    """Records merged by key, the richer text of each field kept."""
    o = archive.objects(spark, d).where("candidate_key is not null")
    m = enrich.richer(o, ["candidate_key"], ["title", "body_text"], "derived_object_id")
    return m.select("candidate_key", F.md5("title").alias("title_digest"), F.md5("body_text").alias("body_digest"), "n_merged")


@R.query(
    sql="""WITH o AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0)
    SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, round(coalesce(n.c_acctbal, o.c_acctbal), 4) AS c_acctbal FROM o FULL JOIN n USING (c_custkey)"""
)
def upsert_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """An upsert in which null does not overwrite."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return enrich.upsert_coalesce(c.where("c_custkey % 3 <> 0"), new, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 4))


@R.query(sql="SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE upper(c_name) END AS c_name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 5 <> 0")
def upsert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """An insert that leaves existing keys alone."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return enrich.upsert_ignore(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 5 <> 0").withColumn("c_name", F.upper("c_name")), ["c_custkey"])


@R.query(sql="SELECT user_id, event_type AS last_type, round(value, 4) AS last_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def change_log_view(spark: SparkSession, d: str) -> DataFrame:
    """The current view of a change log."""
    log = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("last_type"), F.round("value", 4).alias("last_value"))
    return enrich.latest(log, ["user_id"], "event_id")


@R.query(
    sql=f"""WITH {OBJ}, r AS (SELECT DISTINCT artifact_id FROM obj WHERE derived_object_type = 'summary' AND object_status = 'active')
    SELECT derived_object_id, CASE WHEN object_status = 'active' AND r.artifact_id IS NOT NULL THEN 'superseded' ELSE object_status END AS object_status FROM obj LEFT JOIN r USING (artifact_id)"""
)
def supersede_derivations(spark: SparkSession, d: str) -> DataFrame:
    """A rerun supersedes every active object of its artifacts."""
    o = archive.objects(spark, d)
    reruns = o.where("derived_object_type = 'summary' and object_status = 'active'").select("artifact_id")
    return enrich.supersede(o, reruns).select("derived_object_id", "object_status")


@R.query(
    sql="""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents), f AS (SELECT sha, min(doc_id) AS first_id FROM h GROUP BY 1)
    SELECT h.doc_id, f.first_id, h.doc_id = f.first_id AS was_created FROM h JOIN f USING (sha)"""
)
def import_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Content-addressed import: each payload once, repeats point to the first."""
    h = table(spark, d, "documents").select("doc_id", hashing.sha256(F.coalesce("text", F.lit(""))).alias("sha"))
    first = h.groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    return h.join(first, "sha").select("doc_id", "first_id", (F.col("doc_id") == F.col("first_id")).alias("was_created"))


@R.query(
    sql=f"""WITH {OBJ}, k AS (SELECT artifact_id, derived_object_type AS t, count(*) AS n, min(derived_object_id) AS first_id FROM obj WHERE object_status = 'active' GROUP BY 1, 2)
    SELECT artifact_id, string_agg(t || ':' || n || ':' || first_id, ',' ORDER BY t) AS objects, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1"""
)
def artifact_detail(spark: SparkSession, d: str) -> DataFrame:
    """What each artifact holds, by kind: reduced per kind first, so a busy artifact is a handful of rows."""
    o = table(spark, d, "oa_derived_object").where("object_status = 'active'")
    kinds = o.groupBy("artifact_id", "derived_object_type").agg(F.count("*").alias("n"), F.min("derived_object_id").alias("first_id"))
    listed = F.array_sort(F.collect_list(F.struct("derived_object_type", "n", "first_id")))
    return kinds.groupBy("artifact_id").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["derived_object_type"], x["n"], x["first_id"])), ",").alias("objects"), F.sum("n").alias("n"))


@R.query(
    sql=f"""WITH {OBJ}, e AS (SELECT DISTINCT derived_object_id AS name FROM obj WHERE derived_object_type IN ('entity', 'memory'))
    SELECT archive_link_id FROM oa_archive_link l WHERE EXISTS (SELECT 1 FROM e WHERE e.name = l.source_object_id) AND EXISTS (SELECT 1 FROM e WHERE e.name = l.target_object_id)"""
)
def resolved_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations with two known ends."""
    e = table(spark, d, "oa_derived_object").where("derived_object_type in ('entity', 'memory')").select(F.col("derived_object_id").alias("name"))
    return enrich.drop_unresolved(table(spark, d, "oa_archive_link"), e, "source_object_id", "target_object_id", "name").select("archive_link_id")


@R.query(
    sql="""WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS size, len(embedding) AS dims FROM embeddings) SELECT vec_id, round(size, 5) AS size, CAST(dims AS INTEGER) AS dims FROM n"""
)
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """Length and dimension of each vector."""
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("size"), F.size("embedding").alias("dims"))


@R.query()
def stub_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in embedding of every derived object's title and body."""
    body = F.concat_ws("\n\n", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("body_text"), F.lit("")))
    return table(spark, d, "oa_derived_object").select("derived_object_id", vectors.embed(body).alias("embedding"))
