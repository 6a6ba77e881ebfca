"""Search, similarity and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.durable import Workspace
from cairn.functions import text as text_functions
from cairn.functions import vectors
from cairn.operators import graph, lexical, retrieval
from cairn.plans.imports import external_links
from cairn.plans.registry import Registry
from cairn.plans.relational import ART, LNK, OBJ, SEG, TAG
from cairn.sources import archive
from cairn.tables import table

R = Registry()
_FROM, _TO = text_functions._accents()
WORDS = ["retry", "counter", "saddle"]


def _bm25_sql(source: str, key: str, text: str, words: list[str] = WORDS) -> str:
    """The arithmetic of BM25 spelt out."""
    cols = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(sorted(words)))
    stats = ", ".join(f"count_if(f{i} > 0) AS d{i}" for i in range(len(words)))
    parts = " + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * ln_ / av))" for i in range(len(words)))
    return f"""toks AS (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM {source}),
    fr AS (SELECT {key}, len(t) AS ln_, {cols} FROM toks), st AS (SELECT count(*) AS n, avg(ln_) AS av, {stats} FROM fr),
    ranked AS (SELECT {key}, {parts} AS score FROM fr, st WHERE f0 + f1 + f2 > 0)"""


@R.query(
    sql=f"""WITH {SEG}, {_bm25_sql("seg", "segment_id", "text_content")}, h AS (SELECT s.artifact_id, r.segment_id, 300 + greatest(0, CAST(round(r.score * 10) AS INTEGER)) AS score_hint FROM ranked r JOIN seg s USING (segment_id)),
    b AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY score_hint DESC, segment_id) AS rn FROM h)
    SELECT artifact_id, segment_id, score_hint FROM b WHERE rn = 1 ORDER BY score_hint DESC, artifact_id LIMIT 20"""
)
def search_segments(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best artifacts by their best segment under BM25 (a top-k report)."""
    hits = _segment_scores(spark, d, WORDS).select("artifact_id", "segment_id", retrieval.hint(300, F.col("score")).alias("score_hint"))
    return retrieval.best_per(hits, "artifact_id", "score_hint", "segment_id").orderBy(F.desc("score_hint"), "artifact_id").limit(20)


def _segment_scores(spark: SparkSession, d: str, words: list[str]) -> DataFrame:
    """``(segment_id, artifact_id, score)``: texts are counted where they are read, repeated deliveries reduced by their counts."""
    raw = retrieval.counted(table(spark, d, "oa_segment"), F.col("text_content"), words, "segment_id", "artifact_id", "created_at", "sequence_no")
    n = len(set(words))
    first = raw.groupBy("segment_id").agg(F.min_by(F.struct("artifact_id", "_len", *(f"_f{i}" for i in range(n))), F.struct("created_at", "artifact_id", "sequence_no")).alias("s"))
    return retrieval.bm25_counted(first.select("segment_id", "s.*"), n, "segment_id", "artifact_id")


@R.query(sql=f"WITH {OBJ}, txt AS (SELECT derived_object_id, coalesce(title, '') || ' ' || coalesce(body_text, '') AS tx FROM obj WHERE object_status = 'active'), {_bm25_sql('txt', 'derived_object_id', 'tx')} SELECT derived_object_id, round(score, 6) AS score FROM ranked")
def bm25_objects(spark: SparkSession, d: str) -> DataFrame:
    """All active objects with any query word, with their BM25 score."""
    o = table(spark, d, "oa_derived_object").where("object_status = 'active'")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body_text", F.lit("")))
    return retrieval.bm25(o, "derived_object_id", text, WORDS).select("derived_object_id", F.round("score", 6).alias("score"))


@R.query(
    sql=f"WITH docs AS (SELECT doc_id, translate(lower(text), '{_FROM}', '{_TO}') AS tx FROM documents WHERE doc_id IS NOT NULL), {_bm25_sql('docs', 'doc_id', 'tx', ['configuracion', 'retry', 'uber'])} SELECT doc_id, round(score, 6) AS score FROM ranked"
)
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents by a stored index: built once, then read for the terms of the query only, marks of letters aside."""
    space = Workspace(spark, "lexical")
    where = space.location("index")
    docs = table(spark, d, "documents").select("doc_id", "text")
    lexical.build(docs, "doc_id", F.col("text"), where)
    return lexical.ranked(spark, where, "doc_id", "Configuración retry über").select("doc_id", F.round("score", 6).alias("score"))


@R.query(
    sql=f"""WITH {OBJ}, t AS (SELECT derived_object_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(body_text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM obj)
    SELECT derived_object_id FROM t WHERE regexp_matches(t, ' (?:retry (?:[^ ]+ ){{0,4}}counter|counter (?:[^ ]+ ){{0,4}}retry) ')"""
)
def near_search(spark: SparkSession, d: str) -> DataFrame:
    """Objects with two words at most four others apart."""
    return table(spark, d, "oa_derived_object").where(retrieval.matches(F.col("body_text"), "retry NEAR/4 counter")).select("derived_object_id")


@R.query(sql=f"""WITH {OBJ}, j AS (SELECT derived_object_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(body_text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM obj)
    SELECT derived_object_id FROM j WHERE (contains(t, ' retry counter ') OR contains(t, ' sadd')) AND NOT contains(t, ' mare ')""")
def operator_search(spark: SparkSession, d: str) -> DataFrame:
    """An operator expression: phrase, prefix, negation and brackets."""
    o = table(spark, d, "oa_derived_object")
    return o.where(retrieval.matches(F.col("body_text"), '("retry counter" OR sadd*) NOT mare')).select("derived_object_id")


@R.query(
    sql=f"""WITH {OBJ}, t AS (SELECT derived_object_id, artifact_id, list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x IN ('counter', 'retry', 'saddle')) AS a,
        list_filter(regexp_split_to_array(lower(coalesce(body_text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x IN ('counter', 'retry', 'saddle')) AS b FROM obj WHERE object_status = 'active')
    SELECT derived_object_id, artifact_id, CAST(360 + floor(round((1.0 * len(a) + 0.4 * len(b)) * 100, 6)) AS INTEGER) AS score_hint FROM t WHERE len(a) + len(b) > 0"""
)
def ranked_objects(spark: SparkSession, d: str) -> DataFrame:
    """Active objects with any word, ranked by cover density (titles weigh more than bodies)."""
    o = table(spark, d, "oa_derived_object").where("object_status = 'active'")
    rank = retrieval.cover_density({"A": F.col("title"), "B": F.col("body_text")}, WORDS)
    return o.select("derived_object_id", "artifact_id", rank.alias("rank")).where("rank > 0").select("derived_object_id", "artifact_id", retrieval.rank_hint(360, F.col("rank")).alias("score_hint"))


@R.query(
    sql=f"""WITH {ART}, {TAG}, {SEG}, {OBJ}, m AS (
        SELECT artifact_id, artifact_id AS match_record_id, 'artifact_title' AS match_kind, coalesce(title, '') AS snippet, 240 AS score_hint FROM art WHERE contains(lower(coalesce(title, '')), 'retry')
        UNION ALL SELECT artifact_id, artifact_id || '#' || seq, 'imported_note_tag', tag, 380 FROM tag WHERE tag = 'retry'
        UNION ALL SELECT artifact_id, artifact_id, 'imported_note_path', path_key, 220 FROM art WHERE lower(path_key) LIKE '%retry%'
        UNION ALL SELECT artifact_id, derived_object_id, 'derived_object', coalesce(title, body_text, ''), 360 FROM obj WHERE object_status = 'active' AND contains(lower(coalesce(title, '') || ' ' || coalesce(body_text, '')), 'retry')
        UNION ALL SELECT artifact_id, segment_id, 'segment_excerpt', left(coalesce(text_content, ''), 240), 300 FROM seg WHERE contains(lower(coalesce(text_content, '')), 'retry'))
    SELECT * FROM m ORDER BY score_hint DESC, artifact_id, match_record_id LIMIT 200"""
)
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of all kinds in one ranked list, cut once after the union (over-fetch of a search)."""
    found = _candidates(spark, d, ["retry"]).drop("query_text", "matched_fields")
    return found.orderBy(F.desc("score_hint"), "artifact_id", "match_record_id").limit(200)


def _candidates(spark: SparkSession, d: str, texts: list[str]) -> DataFrame:
    obj = table(spark, d, "oa_derived_object").where("object_status = 'active'")
    seg = archive.segments(spark, d, "artifact_id", "text_content")
    return retrieval.candidates(archive.artifacts(spark, d), archive.tags(spark, d), archive.aliases(spark, d), external_links(spark, d), obj, seg, texts)


#: A text shown by links, an address that is the start of others, a tag, a title, and a word of many kinds.
TEXTS = ["site", "https://example.com/7", "de", "The memory card has doubled the rented storage box on a slow connection", "retry"]


@R.query(
    sql=f"""WITH {ART}, {TAG}, {SEG}, {OBJ}, q AS (SELECT unnest([{", ".join(f"'{t}'" for t in TEXTS)}]) AS query_text), w AS (SELECT query_text, lower(query_text) AS x FROM q),
    lnk AS (SELECT artifact_id, 'https://example.com/' || doc_id AS url, 'site' AS shown FROM art WHERE trim(body) <> ''),
    m AS (
        SELECT query_text, artifact_id, artifact_id AS match_record_id, 'artifact_title' AS match_kind, title AS snippet, 240 AS score_hint, ['title'] AS matched_fields FROM art JOIN w ON contains(lower(title), x)
        UNION ALL SELECT query_text, artifact_id, artifact_id || '#' || seq, 'imported_note_tag', tag, 380, ['tag'] FROM tag JOIN w ON tag = x
        UNION ALL SELECT query_text, artifact_id, artifact_id || '#' || x, 'imported_note_alias', title, 370, ['alias'] FROM art JOIN w ON lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) = x
        UNION ALL SELECT query_text, artifact_id, artifact_id, 'imported_note_path', path_key, 220, ['path'] FROM art JOIN w ON contains(lower(path_key), x)
        UNION ALL SELECT query_text, artifact_id, artifact_id || '#1', 'imported_external_link', shown, CASE WHEN url = x THEN 395 WHEN contains(url, x) THEN 390 WHEN contains(shown, x) THEN 250 ELSE 230 END,
            list_filter([CASE WHEN contains(url, x) THEN 'external_url' END, CASE WHEN contains(shown, x) THEN 'display_text' END, CASE WHEN contains(url, x) THEN 'raw_target' END], lambda f: f IS NOT NULL) FROM lnk JOIN w ON contains(url, x) OR contains(shown, x)
        UNION ALL SELECT query_text, artifact_id, derived_object_id, 'derived_object', coalesce(title, body_text, ''), 360,
            list_filter([CASE WHEN contains(lower(title), x) THEN 'title' END, CASE WHEN contains(lower(body_text), x) THEN 'body_text' END], lambda f: f IS NOT NULL) FROM obj JOIN w ON contains(lower(coalesce(title, '') || ' ' || coalesce(body_text, '')), x) WHERE object_status = 'active'
        UNION ALL SELECT query_text, artifact_id, segment_id, 'segment_excerpt', left(text_content, 240), 300, ['text_content'] FROM seg JOIN w ON contains(lower(text_content), x)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY score_hint DESC, artifact_id, match_record_id) AS rn FROM m)
    SELECT * EXCLUDE (rn) REPLACE (array_to_string(matched_fields, ',') AS matched_fields) FROM r WHERE rn <= 200"""
)
def candidate_union_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 200 best candidates of all seven kinds for several texts, with the fields that matched."""
    w = Window.partitionBy("query_text").orderBy(F.desc("score_hint"), "artifact_id", "match_record_id")
    return _candidates(spark, d, TEXTS).withColumn("rn", F.row_number().over(w)).where("rn <= 200").drop("rn").withColumn("matched_fields", F.array_join("matched_fields", ","))


@R.query(
    sql="""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT v.vec_id, greatest(0, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[]))) AS score FROM embeddings v, q)
    SELECT vec_id, round(score, 5) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10"""
)
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of one query vector."""
    e = table(spark, d, "embeddings")
    query = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = e.crossJoin(F.broadcast(query))  # one row
    return scored.select("vec_id", vectors.cosine(F.col("embedding"), F.col("q")).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", F.round("score", 5).alias("score"))


@R.query(
    sql="""WITH q AS (SELECT vec_id AS query_id, label, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT q.query_id, v.vec_id, greatest(0, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[]))) AS sim FROM embeddings v JOIN q ON v.label = q.label AND v.vec_id <> q.query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, round(sim, 5) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""
)
def knn_cross_group(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest neighbours of the same label for every hundredth vector, against all vectors."""
    e = table(spark, d, "embeddings")
    return retrieval.batch_knn(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 3, "label").select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), "rank")


@R.query(
    sql="""WITH q AS (SELECT vec_id AS query_id, label, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT q.query_id, max(greatest(0, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])))) AS best FROM embeddings v JOIN q ON v.label = q.label AND v.vec_id <> q.query_id GROUP BY 1)
    SELECT attach, CASE WHEN best >= attach THEN 'attach' WHEN best < fresh THEN 'create' ELSE 'ambiguous' END AS disposition, CAST(count(*) AS BIGINT) AS n FROM s, (VALUES (0.9::DOUBLE, 0.77::DOUBLE), (0.32, 0.28)) t(attach, fresh) GROUP BY 1, 2"""
)
def reconcile_disposition(spark: SparkSession, d: str) -> DataFrame:
    """Dispositions of new records by the similarity of their nearest neighbour, under two pairs of thresholds."""
    e = table(spark, d, "embeddings")
    best = retrieval.batch_knn(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 1, "label")
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("attach"), F.lit(f).alias("fresh")) for a, f in ((0.9, 0.77), (0.32, 0.28))))).alias("t")
    each = best.select("similarity", pairs).select("similarity", "t.*")
    kind = F.when(F.col("similarity") >= F.col("attach"), "attach").when(F.col("similarity") < F.col("fresh"), "create").otherwise("ambiguous")
    return each.groupBy("attach", kind.alias("disposition")).agg(F.count("*").alias("n"))


@R.query(
    sql=f"""WITH {OBJ}, txt AS (SELECT CAST(regexp_extract(derived_object_id, '-(\\d+)-[^-]*$', 1) AS BIGINT) AS vec_id, coalesce(title, '') || ' ' || coalesce(body_text, '') AS tx FROM obj WHERE object_status = 'active'), {_bm25_sql('txt', 'vec_id', 'tx')},
    q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), sm AS (SELECT vec_id, greatest(0, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[]))) AS sem FROM embeddings v, q),
    b AS (SELECT coalesce(r.vec_id, s.vec_id) AS vec_id, CASE WHEN s.sem IS NULL THEN 0.4 * r.score / (r.score + 1) WHEN r.score IS NULL THEN least(1, s.sem) ELSE 0.4 * r.score / (r.score + 1) + 0.6 * least(1, s.sem) END AS score FROM ranked r FULL JOIN sm s ON r.vec_id = s.vec_id)
    SELECT vec_id, round(score, 4) AS score FROM b ORDER BY round(b.score, 9) DESC, vec_id LIMIT 100"""
)
def blended_search(spark: SparkSession, d: str) -> DataFrame:
    """The hundred best records by lexical and semantic score; an object's vector bears its number."""
    o = table(spark, d, "oa_derived_object").where("object_status = 'active'")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body_text", F.lit("")))
    number = F.regexp_extract("derived_object_id", r"-(\d+)-[^-]*$", 1).try_cast("long")
    lexical = retrieval.bm25(o.select(number.alias("vec_id"), text.alias("t")), "vec_id", F.col("t"), WORDS)
    e = table(spark, d, "embeddings")
    query = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    semantic = e.crossJoin(F.broadcast(query)).select("vec_id", vectors.cosine(F.col("embedding"), F.col("q")).alias("score"))
    best = retrieval.blend(lexical, semantic, "vec_id").orderBy(F.desc(F.round("score", 9)), "vec_id").limit(100)
    return best.select("vec_id", F.round("score", 4).alias("score"))


@R.query(
    sql=f"""WITH {LNK}, s AS (SELECT DISTINCT derived_object_id AS node FROM oa_derived_object)
    SELECT node, neighbour, kind FROM (SELECT l.source_object_id AS node, l.target_object_id AS neighbour, l.link_type AS kind FROM lnk l UNION ALL SELECT l.target_object_id, l.source_object_id, l.link_type FROM lnk l) JOIN s USING (node)"""
)
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Direct neighbours of all objects, in both directions."""
    starts = table(spark, d, "oa_derived_object").select(F.col("derived_object_id").alias("node"))
    return graph.neighbours(starts, archive.links(spark, d), "source_object_id", "target_object_id", "link_type")


_KEYED = """k AS (SELECT o.derived_object_id AS node, p.derived_object_id AS neighbour, row_number() OVER (PARTITION BY o.derived_object_id ORDER BY p.derived_object_id) AS rn
    FROM obj o JOIN obj p ON p.candidate_key = o.candidate_key AND p.derived_object_id <> o.derived_object_id WHERE p.object_status = 'active')"""


@R.query(sql=f"WITH {OBJ}, {_KEYED} SELECT node, neighbour FROM k WHERE rn <= 20")
def shared_key_join(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty active objects that share a candidate key, for every object."""
    o = archive.objects(spark, d).select("derived_object_id", "candidate_key", "object_status")
    active = o.where("object_status = 'active'")
    # starts need not be active, so they bring their own keys
    return graph.shared_key(o.select(F.col("derived_object_id").alias("node")), active, "candidate_key", "derived_object_id", own=o).select("node", "neighbour")


@R.query(
    sql=f"""WITH {LNK}, {OBJ}, {_KEYED},
    a AS (SELECT derived_object_id FROM obj WHERE object_status = 'active'), s AS (SELECT derived_object_id AS node FROM obj),
    l AS (SELECT node, neighbour, min(archive_link_id) AS e FROM (SELECT source_object_id AS node, target_object_id AS neighbour, archive_link_id FROM lnk UNION ALL SELECT target_object_id, source_object_id, archive_link_id FROM lnk)
        JOIN s USING (node) WHERE neighbour IN (SELECT derived_object_id FROM a) GROUP BY 1, 2),
    u AS (SELECT node, neighbour, 0 AS branch, e AS o FROM l UNION ALL SELECT node, neighbour, 1, neighbour FROM k),
    b AS (SELECT node, neighbour, min(branch) AS branch, arg_min(o, branch) AS o FROM u GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY branch, o, neighbour) AS place FROM b)
    SELECT node, neighbour, CASE branch WHEN 0 THEN 'link' ELSE 'shared_key' END AS relation, CAST(place AS INTEGER) AS place FROM r WHERE place <= 20"""
)
def related_objects(spark: SparkSession, d: str) -> DataFrame:
    """The twenty nearest active objects of every object: linked ones first, then by shared key."""
    o = archive.objects(spark, d).select("derived_object_id", "candidate_key", "object_status")
    active = o.where("object_status = 'active'")
    alive = active.select(F.col("derived_object_id").alias("neighbour"))
    edges = archive.links(spark, d).select(F.col("source_object_id").alias("source"), F.col("target_object_id").alias("target"), F.col("archive_link_id").alias("edge_id"))
    return graph.related(o.select(F.col("derived_object_id").alias("node")), edges, active, "candidate_key", "derived_object_id", 20, own=o, alive=alive)


@R.query(
    sql=f"""WITH {ART}, {TAG}, t AS (SELECT DISTINCT tag, artifact_id FROM tag), h AS (SELECT tag, min(artifact_id) AS hub, count(*) AS n FROM t GROUP BY 1 HAVING count(*) > 1)
    SELECT t.tag, h.hub, t.artifact_id, CAST(h.n AS BIGINT) AS n_members FROM t JOIN h USING (tag)"""
)
def shared_tag_stars(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts linked through a shared tag, as stars."""
    return graph.groups_by_value(archive.tags(spark, d), "artifact_id", "tag").select("tag", "hub", "artifact_id", "n_members")


@R.query(
    sql=f"""WITH {ART}, al AS (SELECT artifact_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS alias FROM art WHERE title IS NOT NULL),
    u AS (SELECT alias, min(artifact_id) AS resolved FROM al WHERE alias <> '' GROUP BY 1 HAVING count(DISTINCT artifact_id) = 1), ln AS (SELECT DISTINCT alias AS target FROM al WHERE alias <> '')
    SELECT ln.target, u.resolved FROM ln LEFT JOIN u ON u.alias = ln.target"""
)
def unique_alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Aliases resolved where exactly one artifact bears them."""
    a = archive.aliases(spark, d)
    wanted = a.select(F.col("alias").alias("target")).distinct()
    return graph.resolve_unique(wanted, "target", a, "alias", "artifact_id").select("target", "resolved")


@R.query(
    sql=f"""WITH {LNK}, {OBJ} SELECT l.archive_link_id, l.link_type, a.artifact_id AS source_owner, b.artifact_id AS target_owner FROM lnk l JOIN obj a ON a.derived_object_id = l.source_object_id
    JOIN obj b ON b.derived_object_id = l.target_object_id WHERE a.artifact_id <> b.artifact_id"""
)
def artifact_edges(spark: SparkSession, d: str) -> DataFrame:
    """Object links lifted to artifacts."""
    e = graph.both_ends(archive.links(spark, d), "source_object_id", "target_object_id", archive.objects(spark, d), "derived_object_id", "artifact_id")
    return e.select("archive_link_id", "link_type", "source_owner", "target_owner")


@R.query(sql="SELECT DISTINCT least(source_object_id, target_object_id) AS low_id, greatest(source_object_id, target_object_id) AS high_id, link_type FROM oa_archive_link WHERE source_object_id IS NOT NULL AND target_object_id IS NOT NULL AND source_object_id <> target_object_id")
def canonical_edges(spark: SparkSession, d: str) -> DataFrame:
    """Undirected edges, each once."""
    e = table(spark, d, "oa_archive_link").where("source_object_id is not null and target_object_id is not null and source_object_id <> target_object_id")
    return e.select(F.least("source_object_id", "target_object_id").alias("low_id"), F.greatest("source_object_id", "target_object_id").alias("high_id"), "link_type").distinct()


@R.query(
    sql=f"""WITH {OBJ}, m(intent, kind) AS (VALUES ('memory_match', 'memory'), ('relationship_lookup', 'relationship'), ('topic_lookup', 'classification'), ('entity_lookup', 'entity')),
    r AS (SELECT m.intent, o.derived_object_id, row_number() OVER (PARTITION BY m.intent ORDER BY o.confidence_score DESC NULLS LAST, o.derived_object_id) AS rn FROM m JOIN obj o ON o.derived_object_type = m.kind
        WHERE o.object_status = 'active' AND contains(lower(coalesce(o.title, '') || ' ' || coalesce(o.body_text, '')), 'retry'))
    SELECT intent, derived_object_id, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 5"""
)
def intent_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The five best objects for each kind of intent."""
    kinds = spark.createDataFrame([("memory_match", "memory"), ("relationship_lookup", "relationship"), ("topic_lookup", "classification"), ("entity_lookup", "entity")], "intent string, derived_object_type string")
    o = table(spark, d, "oa_derived_object").where("object_status = 'active'")
    o = o.where(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body_text", F.lit("")))).contains("retry"))
    w = Window.partitionBy("intent").orderBy(F.desc_nulls_last("confidence_score"), "derived_object_id")
    return o.join(F.broadcast(kinds), "derived_object_type").select("intent", "derived_object_id", F.row_number().over(w).alias("rank")).where("rank <= 5")
