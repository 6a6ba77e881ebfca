"""Composite views: archive search, filtered lists, artifact detail, context packs, vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import vectors
from cairn.operators import graph, retrieval, vectorstore
from cairn.plans.imports import external_links
from cairn.plans.registry import Registry
from cairn.plans.relational import ART, LNK, OBJ, SEG, TAG
from cairn.plans.search import _segment_scores
from cairn.sources import archive
from cairn.tables import table

R = Registry()

ALIAS_TEXT = "the memory card has doubled the rented storage box on a slow connection"
FILTER_SETS = {
    "tag": archive.Filters(tag="de"),
    "path_and_time": archive.Filters(source_type="markdown_file", path_prefix="markdown_file/en", captured_from_us=1704067200000000, captured_before_us=1767225600000000),
    "status": archive.Filters(source_type="text_file", enrichment_status="failed"),
    "alias": archive.Filters(alias=ALIAS_TEXT),
    "none": archive.Filters(),
}
_LISTED = {
    "tag": "EXISTS (SELECT 1 FROM tag t WHERE t.artifact_id = a.artifact_id AND t.tag = 'de')",
    "path_and_time": "source_type = 'markdown_file' AND starts_with(lower(path_key), 'markdown_file/en') AND captured_us >= 1704067200000000 AND captured_us < 1767225600000000",
    "status": "source_type = 'text_file' AND enrichment_status = 'failed'",
    "alias": f"lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) = '{ALIAS_TEXT}'",
    "none": "true",
}


@R.query(
    sql=f"WITH {ART}, {TAG} " + " UNION ALL ".join(f"(SELECT '{name}' AS filter_name, artifact_id, source_type, captured_us, enrichment_status FROM art a WHERE {where} ORDER BY captured_us DESC NULLS LAST, artifact_id LIMIT 50)" for name, where in _LISTED.items())
)
def list_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """The first page of artifacts under several sets of optional filters (the page is the feature)."""
    pages = []
    for name, filters in FILTER_SETS.items():
        found = archive.filtered(spark, d, filters).orderBy(F.desc_nulls_last("captured_us"), "artifact_id").limit(50)
        pages.append(found.select(F.lit(name).alias("filter_name"), "artifact_id", "source_type", "captured_us", "enrichment_status"))
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out


def search_candidates(spark: SparkSession, d: str, query: str) -> DataFrame:
    """``(artifact_id, match_record_id, match_kind, score_hint)`` of all seven kinds of match, not yet cut.

    Titles, objects and segments match by any word and are ranked by BM25 over the whole archive; tags
    and aliases match wholly, paths and external links in part.
    """
    words, low = retrieval.plain_words(query), query.strip().lower()
    n = len(set(words))
    row = lambda df, kind, record, score: df.select("artifact_id", record.alias("match_record_id"), F.lit(kind).alias("match_kind"), score.cast("int").alias("score_hint"))
    ranked = lambda base: retrieval.hint(base, F.col("score"))
    art = archive.artifacts(spark, d)
    branches = []
    if n:
        titles = retrieval.bm25_counted(retrieval.counted(art.select("artifact_id", "title"), F.col("title"), words, "artifact_id"), n, "artifact_id")
        objects = table(spark, d, "oa_derived_object").where("object_status = 'active'")
        text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body_text", F.lit("")))
        objects = retrieval.bm25_counted(retrieval.counted(objects, text, words, "derived_object_id", "artifact_id"), n, "derived_object_id", "artifact_id")
        branches += [
            row(titles, "artifact_title", F.col("artifact_id"), ranked(240)),
            row(objects, "derived_object", F.col("derived_object_id"), ranked(360)),
            row(_segment_scores(spark, d, words), "segment_excerpt", F.col("segment_id"), ranked(300)),
        ]
    links = external_links(spark, d)
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(low)
    if low:
        branches += [
            row(archive.tags(spark, d).where(F.col("tag") == low), "imported_note_tag", F.concat_ws("#", "artifact_id", "seq"), F.lit(380)),
            row(archive.aliases(spark, d).where(F.col("alias") == low), "imported_note_alias", F.concat_ws("#", "artifact_id", "alias"), F.lit(370)),
            row(art.where(has("path_key")), "imported_note_path", F.col("artifact_id"), F.lit(220)),
            row(links.where(has("external_url") | has("display_text") | has("raw_target")), "imported_external_link", F.concat_ws("#", "artifact_id", "seq"), retrieval.link_score(F.col("external_url"), F.col("display_text"), F.lit(low))),
        ]
    if not branches:
        return spark.createDataFrame([], "artifact_id string, match_record_id string, match_kind string, score_hint int")
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out


def search(spark: SparkSession, d: str, query: str, filters: archive.Filters | None = None, limit: int = 20, semantic: DataFrame | None = None) -> DataFrame:
    """Ranked artifacts for a text: ``(place, artifact_id, score, n_matches, best_kind, kinds, found_by)``.

    The best candidates (eight times the limit, 200 at most, as documented for this search) are grouped
    by artifact.  Where they leave places free, the text has three words or more and no filter is set,
    ``semantic(artifact_id, score)`` fills them.  A blank text finds nothing.
    """
    found = search_candidates(spark, d, query)
    if filters and filters.any():
        found = found.join(archive.filtered(spark, d, filters).select("artifact_id"), "artifact_id", "left_semi")
    top = found.orderBy(F.desc("score_hint"), "artifact_id", "match_record_id").limit(max(limit, min(8 * limit, 200)))
    hits = top.groupBy("artifact_id").agg(
        (F.max("score_hint") / 100).alias("score"), F.count("*").alias("n_matches"),
        F.min_by("match_kind", F.struct(-F.col("score_hint"), "match_record_id")).alias("best_kind"), F.array_join(F.array_sort(F.collect_set("match_kind")), ",").alias("kinds"),
    ).withColumn("found_by", F.lit("words"))
    plain = filters is None or not (filters.source_type or filters.tag or filters.alias or filters.path_prefix)
    if semantic is not None and plain and len(query.split()) >= 3:
        more = semantic.join(hits.select("artifact_id"), "artifact_id", "left_anti")
        hits = hits.unionByName(more.select("artifact_id", F.col("score").cast("double").alias("score"), F.lit(1).cast("long").alias("n_matches"), F.lit("derived_object").alias("best_kind"), F.lit("derived_object").alias("kinds"), F.lit("vector").alias("found_by")))
    order = [F.when(F.col("found_by") == "words", 0).otherwise(1), F.desc("score"), F.col("artifact_id")]
    page = hits.orderBy(*order).limit(limit)
    return page.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most ``limit`` rows


def _bm(p: str, source: str, keys: str, text: str, words: list[str]) -> str:
    """The arithmetic of BM25 over one source, its parts named by a prefix."""
    ws = sorted(set(words))
    cols = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(ws))
    stats = ", ".join(f"count_if(f{i} > 0) AS d{i}" for i in range(len(ws)))
    parts = " + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * ln_ / av))" for i in range(len(ws)))
    some = " + ".join(f"f{i}" for i in range(len(ws)))
    return f"""{p}t AS (SELECT {keys}, list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM {source}),
    {p}f AS (SELECT {keys}, len(t) AS ln_, {cols} FROM {p}t), {p}s AS (SELECT count(*) AS n, avg(ln_) AS av, {stats} FROM {p}f),
    {p}r AS (SELECT {keys}, CAST(greatest(0, round(({parts}) * 10)) AS INTEGER) AS bonus FROM {p}f, {p}s WHERE {some} > 0)"""


def _search_sql(query: str, limit: int, where: str, semantic: bool) -> str:
    words, low = retrieval.plain_words(query), query.strip().lower()
    more = "UNION ALL SELECT artifact_id, score, 1, 'derived_object', 'derived_object', 'vector' FROM sem WHERE artifact_id NOT IN (SELECT artifact_id FROM hits)" if semantic else ""
    return f"""WITH {ART}, {TAG}, {SEG}, {OBJ}, lnk AS (SELECT artifact_id, 'https://example.com/' || doc_id AS url, 'site' AS shown FROM art WHERE trim(body) <> ''),
    act AS (SELECT derived_object_id, artifact_id, coalesce(title, '') || ' ' || coalesce(body_text, '') AS tx FROM obj WHERE object_status = 'active'),
    {_bm('ttl', 'art', 'artifact_id', 'title', words)}, {_bm('dob', 'act', 'derived_object_id, artifact_id', 'tx', words)}, {_bm('sgm', 'seg', 'segment_id, artifact_id', 'text_content', words)},
    m AS (SELECT artifact_id, artifact_id AS rec, 'artifact_title' AS kind, 240 + bonus AS hint FROM ttlr
        UNION ALL SELECT artifact_id, derived_object_id, 'derived_object', 360 + bonus FROM dobr
        UNION ALL SELECT artifact_id, segment_id, 'segment_excerpt', 300 + bonus FROM sgmr
        UNION ALL SELECT artifact_id, artifact_id || '#' || seq, 'imported_note_tag', 380 FROM tag WHERE tag = '{low}'
        UNION ALL SELECT artifact_id, artifact_id || '#{low}', 'imported_note_alias', 370 FROM art WHERE lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) = '{low}'
        UNION ALL SELECT artifact_id, artifact_id, 'imported_note_path', 220 FROM art WHERE contains(lower(path_key), '{low}')
        UNION ALL SELECT artifact_id, artifact_id || '#1', 'imported_external_link', CASE WHEN url = '{low}' THEN 395 WHEN contains(url, '{low}') THEN 390 WHEN contains(shown, '{low}') THEN 250 ELSE 230 END FROM lnk WHERE contains(url, '{low}') OR contains(shown, '{low}')),
    top AS (SELECT * FROM m WHERE {where} ORDER BY hint DESC, artifact_id, rec LIMIT {max(limit, min(8 * limit, 200))}),
    hits AS (SELECT artifact_id, max(hint) / 100 AS score, count(*) AS n_matches, arg_min(kind, (-hint, rec)) AS best_kind, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, 'words' AS found_by FROM top GROUP BY 1),
    q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), sem AS (SELECT 'doc-' || vec_id AS artifact_id, round(greatest(0, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[]))), 5) AS score FROM embeddings v, q),
    u AS (SELECT * FROM hits {more})
    SELECT CAST(row_number() OVER (ORDER BY CASE found_by WHEN 'words' THEN 0 ELSE 1 END, score DESC, artifact_id) AS INTEGER) AS place, artifact_id, round(score, 5) AS score, CAST(n_matches AS BIGINT) AS n_matches, best_kind, kinds, found_by
    FROM u ORDER BY place LIMIT {limit}"""


SEARCH, FILTERED = ("retry counter saddle", 150), ("site", 20)


@R.query(sql=_search_sql(*SEARCH, "true", True))
def search_archive(spark: SparkSession, d: str) -> DataFrame:
    """A search over the whole archive, by words and, where places are left, by vectors."""
    e = table(spark, d, "embeddings")
    query = e.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    near = e.crossJoin(F.broadcast(query)).select(F.concat(F.lit("doc-"), "vec_id").alias("artifact_id"), F.round(vectors.cosine(F.col("embedding"), F.col("q")), 5).alias("score"))
    return search(spark, d, SEARCH[0], None, SEARCH[1], near).withColumn("score", F.round("score", 5))


@R.query(sql=_search_sql(*FILTERED, "artifact_id IN (SELECT a.artifact_id FROM art a JOIN tag t ON t.artifact_id = a.artifact_id AND t.tag = 'en' WHERE source_type = 'markdown_file')", False))
def search_archive_filtered(spark: SparkSession, d: str) -> DataFrame:
    """A search below filters: candidates of other artifacts are dropped before the cut."""
    found = search(spark, d, FILTERED[0], archive.Filters(source_type="markdown_file", tag="en"), FILTERED[1])
    return found.withColumn("score", F.round("score", 5))


@R.query(
    sql=f"""WITH {SEG}, {OBJ}, {LNK}, s AS (SELECT artifact_id, segment_id, row_number() OVER (PARTITION BY artifact_id ORDER BY sequence_no NULLS LAST, segment_id) AS rn FROM seg),
    sp AS (SELECT artifact_id, count(*) AS n, string_agg(CASE WHEN rn <= 5 THEN segment_id END, ' ' ORDER BY rn) AS page FROM s GROUP BY 1),
    o AS (SELECT artifact_id, derived_object_id, row_number() OVER (PARTITION BY artifact_id ORDER BY derived_object_type, derived_object_id) AS rn FROM obj WHERE object_status = 'active'),
    op AS (SELECT artifact_id, count(*) AS n, string_agg(CASE WHEN rn <= 5 THEN derived_object_id END, ' ' ORDER BY rn) AS page FROM o GROUP BY 1),
    e AS (SELECT b.artifact_id, count(*) AS n FROM lnk l JOIN obj b ON b.derived_object_id = l.source_object_id GROUP BY 1)
    SELECT artifact_id, CAST(sp.n AS BIGINT) AS n_segments, sp.page AS first_segments, CAST(coalesce(op.n, 0) AS BIGINT) AS n_objects, coalesce(op.page, '') AS first_objects, CAST(coalesce(e.n, 0) AS BIGINT) AS n_links
    FROM sp LEFT JOIN op USING (artifact_id) LEFT JOIN e USING (artifact_id)"""
)
def artifact_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every artifact with the first page of its segments and of its active objects, and its links.

    Pages are cut by group limits before they are put together, so no artifact is gathered whole.
    """

    def page(df: DataFrame, item: str, name: str, *order) -> DataFrame:
        first = df.withColumn("_rn", F.row_number().over(Window.partitionBy("artifact_id").orderBy(*order))).where("_rn <= 5")
        listed = first.groupBy("artifact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", item))), lambda x: x[item]), " ").alias(f"first_{name}"))
        return df.groupBy("artifact_id").agg(F.count("*").alias(f"n_{name}")).join(listed, "artifact_id")

    segments = page(archive.segments(spark, d, "artifact_id", "sequence_no"), "segment_id", "segments", F.asc_nulls_last("sequence_no"), "segment_id")
    o = archive.objects(spark, d)
    objects = page(o.where("object_status = 'active'").select("artifact_id", "derived_object_id", "derived_object_type"), "derived_object_id", "objects", "derived_object_type", "derived_object_id")
    ends = archive.links(spark, d).groupBy(F.col("source_object_id").alias("derived_object_id")).count()
    links = ends.join(o.select("derived_object_id", "artifact_id"), "derived_object_id").groupBy("artifact_id").agg(F.sum("count").alias("n_links"))
    both = segments.join(objects, "artifact_id", "left").join(links, "artifact_id", "left")
    return both.select("artifact_id", "n_segments", "first_segments", F.coalesce("n_objects", F.lit(0)).alias("n_objects"), F.coalesce("first_objects", F.lit("")).alias("first_objects"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@R.query(
    sql=f"""WITH {OBJ}, act AS (SELECT * FROM obj WHERE object_status = 'active' AND artifact_id IS NOT NULL),
    b AS (SELECT artifact_id, derived_object_type AS bucket, derived_object_id, row_number() OVER (PARTITION BY artifact_id, derived_object_type ORDER BY derived_object_id) AS place FROM act),
    k AS (SELECT DISTINCT artifact_id, candidate_key FROM act WHERE candidate_key IS NOT NULL),
    x AS (SELECT k.artifact_id, o.derived_object_id, row_number() OVER (PARTITION BY k.artifact_id ORDER BY o.candidate_key, o.derived_object_id) AS place FROM k JOIN act o ON o.candidate_key = k.candidate_key AND o.artifact_id <> k.artifact_id)
    SELECT artifact_id, bucket, derived_object_id, CAST(place AS INTEGER) AS place FROM b WHERE place <= 30
    UNION ALL SELECT artifact_id, 'related', derived_object_id, CAST(place AS INTEGER) FROM x WHERE place <= 30"""
)
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """The context of every artifact: up to thirty active objects of each kind, and related ones of other artifacts."""
    act = archive.objects(spark, d).where("object_status = 'active' and artifact_id is not null").select("artifact_id", "derived_object_id", F.col("derived_object_type").alias("bucket"), "candidate_key")
    w = Window.partitionBy("artifact_id", "bucket").orderBy("derived_object_id")
    own = act.withColumn("place", F.row_number().over(w)).where("place <= 30").select("artifact_id", "bucket", "derived_object_id", "place")
    near = graph.keyed_elsewhere(act, "artifact_id", "candidate_key", "derived_object_id", 30)
    return own.unionByName(near.select("artifact_id", F.lit("related").alias("bucket"), "derived_object_id", "place"))


@R.query(
    sql=f"""WITH {ART}, al AS (SELECT DISTINCT artifact_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS alias FROM art WHERE title IS NOT NULL),
    h AS (SELECT alias, min(artifact_id) AS hub, count(*) AS n FROM al WHERE alias <> '' GROUP BY 1 HAVING count(*) > 1)
    SELECT alias, hub, artifact_id, CAST(n AS BIGINT) AS n_members FROM al JOIN h USING (alias)"""
)
def shared_alias_stars(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts linked through a shared alias, as stars."""
    return graph.groups_by_value(archive.aliases(spark, d), "artifact_id", "alias").select("alias", "hub", "artifact_id", "n_members")


@R.query(
    sql=f"""WITH {ART}, {TAG}, al AS (SELECT DISTINCT artifact_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS v FROM art WHERE title IS NOT NULL), tg AS (SELECT DISTINCT artifact_id, tag AS v FROM tag),
    ah AS (SELECT v, min(artifact_id) AS hub FROM al WHERE v <> '' GROUP BY 1 HAVING count(*) > 1), th AS (SELECT v, min(artifact_id) AS hub FROM tg WHERE v <> '' GROUP BY 1 HAVING count(*) > 1),
    u AS (SELECT v AS alias, min(artifact_id) AS target FROM al WHERE v <> '' GROUP BY 1 HAVING count(*) = 1)
    SELECT 'shared_alias' AS kind, al.artifact_id AS source, hub AS target, v AS value FROM al JOIN ah USING (v) WHERE al.artifact_id <> hub
    UNION ALL SELECT 'shared_tag', tg.artifact_id, hub, v FROM tg JOIN th USING (v) WHERE tg.artifact_id <> hub
    UNION ALL SELECT 'mention', o.artifact_id, u.target, u.alias FROM (SELECT DISTINCT artifact_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS v FROM oa_derived_object WHERE title IS NOT NULL) o JOIN u ON u.alias = o.v WHERE o.artifact_id <> u.target"""
)
def structural_links(spark: SparkSession, d: str) -> DataFrame:
    """The structural edges of the archive in one table: shared aliases, shared tags, and titles that name exactly one artifact."""
    from cairn.functions import text

    aliases, tags = archive.aliases(spark, d), archive.tags(spark, d)
    named = table(spark, d, "oa_derived_object").where("title is not null").select("artifact_id", text.alias(F.col("title")).alias("alias")).distinct()
    return graph.structural(aliases, tags, named)


@R.query(
    sql="""WITH q AS (SELECT embedding AS e, label AS l FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, greatest(0, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[]))) AS score FROM embeddings v, q WHERE v.label <> q.l AND vec_id % 7 <> 0)
    SELECT vec_id, label, round(score, 5) AS score FROM s ORDER BY round(s.score, 9) DESC, vec_id LIMIT 15"""
)
def vector_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors under a condition that must and one that must not hold; filters come before the cut."""
    e = table(spark, d, "embeddings")
    first = e.where("vec_id = 0").select("embedding", "label").first()
    hits = vectorstore.search(e, "vec_id", "embedding", first["embedding"], 15, must=[F.col("vec_id") % 7 != 0], must_not=[F.col("label") == first["label"]])
    return hits.join(e.select("vec_id", "label"), "vec_id").select("vec_id", "label", F.round("score", 5).alias("score"))


@R.query(
    sql="""WITH u AS (SELECT vec_id, label, 0 AS g FROM embeddings UNION ALL SELECT vec_id, label + 100, 1 FROM embeddings WHERE vec_id % 10 = 0 UNION ALL SELECT vec_id + 1000000000, label, 1 FROM embeddings WHERE vec_id % 50 = 0),
    l AS (SELECT vec_id, arg_max(label, g) AS label FROM u GROUP BY 1) SELECT label, CAST(count(*) AS BIGINT) AS n, max(vec_id) AS last_id FROM l GROUP BY 1"""
)
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Points after an upsert that changes every tenth and adds some, by label."""
    e = table(spark, d, "embeddings")
    new = e.where("vec_id % 10 = 0").withColumn("label", F.col("label") + 100).unionByName(e.where("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000_000))
    points = vectorstore.upsert(e, new, "vec_id", "embedding")
    return points.groupBy("label").agg(F.count("*").alias("n"), F.max("vec_id").alias("last_id"))


@R.query(
    sql="""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, greatest(0, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[]))) AS score FROM embeddings v, q),
    r AS (SELECT vec_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rn FROM s), h AS (SELECT * FROM r WHERE rn <= 80),
    j AS (SELECT d.doc_id, d.title, h.score, row_number() OVER (ORDER BY h.rn) AS place FROM h JOIN documents d ON d.doc_id = h.vec_id WHERE d.title IS NOT NULL AND d.lang = 'en')
    SELECT CAST(place AS INTEGER) AS place, doc_id, title, round(score, 5) AS score FROM j WHERE place <= 10"""
)
def vector_hydrated(spark: SparkSession, d: str) -> DataFrame:
    """Vector hits with their rows: hits keep their order, those without a fitting row drop out."""
    e = table(spark, d, "embeddings")
    first = e.where("vec_id = 0").select("embedding").first()
    hits = vectorstore.search(e, "vec_id", "embedding", first["embedding"], 80)
    rows = table(spark, d, "documents").where("title is not null and lang = 'en'").select(F.col("doc_id").alias("vec_id"), "title")
    found = vectorstore.hydrate(hits, rows, "vec_id", 10)
    return found.select("place", F.col("vec_id").alias("doc_id"), "title", F.round("score", 5).alias("score"))


@R.query(
    sql="""WITH q AS (SELECT vec_id AS query_id, label, vec_id // 3 AS owner, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT q.query_id, v.vec_id, greatest(0, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[]))) AS sim FROM embeddings v JOIN q ON v.label = q.label AND v.vec_id // 3 <> q.owner),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, round(sim, 5) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""
)
def reconcile_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest records of the same kind in other artifacts, for every hundredth vector."""
    e = table(spark, d, "embeddings").withColumn("owner", F.floor(F.col("vec_id") / 3))
    near = retrieval.batch_knn(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 3, "label", other="owner")
    return near.select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), "rank")
