"""Queries of the general training-data operators: nested records and timestamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import timestamps
from cairn.operators.nested import NodeType, link, node_tables
from cairn.plans.registry import Registry
from cairn.sources import exports
from cairn.tables import table

R = Registry()

#: A text is blank when it holds nothing but white space of any script.
_FULL = r"(?U)\S"


@R.query(
    sql="""
    WITH m AS (SELECT record_id, unnest(chat_messages) AS msg, generate_subscripts(chat_messages, 1) - 1 AS message_index FROM claude_export),
    p AS (SELECT record_id, message_index, unnest(msg.content) AS part, generate_subscripts(msg.content, 1) - 1 AS part_index FROM m),
    g AS (SELECT record_id, unnest(responses) AS r, generate_subscripts(responses, 1) - 1 AS message_index FROM grok_export)
    SELECT DISTINCT 'claude_export' AS source, record_id, CAST(message_index AS INTEGER) AS message_index, CAST(part_index AS INTEGER) AS part_index
    FROM p WHERE regexp_matches(part.thinking, '[^\\s]')
    UNION
    SELECT DISTINCT 'grok_export', record_id, CAST(message_index AS INTEGER), CAST(0 AS INTEGER)
    FROM g WHERE regexp_matches(r.response.message, '[^\\s]')
    """
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Content parts that carry thinking, and responses that carry a message.

    Of the trees only the leaves asked for are read; the labels of what is left name every part's
    message, and every response's envelope, by interval containment.
    """
    labels = ["record_id", "pre", "post", "position"]
    claude = exports.read_paths(spark, d, "claude_export", ["record_id", "chat_messages.content.thinking"])
    part = NodeType("part", "content", {"thinking": "thinking"})
    tables = node_tables(claude, ["record_id"], (NodeType("message", "chat_messages", children=(part,)),))
    parts = link(tables["part"].where(F.col("thinking").rlike(_FULL)).select(*labels), tables["message"], "record_id", {"message_index": "position"})
    grok = exports.read_paths(spark, d, "grok_export", ["record_id", "responses.response.message"])
    tables = node_tables(grok, ["record_id"], (NodeType("response", "responses", {"message": "response.message"}),), "envelope")
    responses = link(tables["response"].where(F.col("message").rlike(_FULL)).select(*labels), tables["envelope"], "record_id", {"envelope": "pre"})
    return (
        parts.where("message_index is not null")
        .select(F.lit("claude_export").alias("source"), "record_id", "message_index", F.col("position").alias("part_index"))
        .unionByName(responses.where("envelope is not null").select(F.lit("grok_export").alias("source"), "record_id", F.col("position").alias("message_index"), F.lit(0).alias("part_index")))
    )


#: Every type of node below a record, with the type of its parent.
_PARENTS = {
    "claude_export": {"message": "conversation", "part": "message", "attachment": "message", "file": "message"},
    "grok_export": {"response": "envelope", "web_result": "response"},
    "gemini_export": {"html_item": "activity", "subtitle": "activity", "attached_file": "activity"},
}


def _labelled(spark: SparkSession, d: str) -> dict[str, dict[str, DataFrame]]:
    """The node tables of the three nested exports."""
    makers = {"claude_export": exports.claude_nodes, "grok_export": exports.grok_nodes, "gemini_export": exports.gemini_nodes}
    return {source: make(table(spark, d, source)) for source, make in makers.items()}


@R.query()
def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every node of the nested exports with its labels."""
    each = [t.select(F.lit(source).alias("source"), F.lit(node).alias("node"), "record_id", "pre", "post", "parent_pre", "position") for source, tables in _labelled(spark, d).items() for node, t in tables.items()]
    return reduce(DataFrame.unionByName, each)


@R.query(
    sql="""
    WITH c AS (SELECT record_id, unnest(chat_messages) AS m, generate_subscripts(chat_messages, 1) - 1 AS i FROM claude_export),
    g AS (SELECT record_id, unnest(responses) AS r, generate_subscripts(responses, 1) - 1 AS i FROM grok_export),
    n AS (SELECT 'claude_export' AS source, 'message' AS node, record_id, 0 AS p, i, m IS NOT NULL AS there FROM c
        UNION ALL SELECT 'claude_export', 'part', record_id, i, generate_subscripts(m.content, 1) - 1, unnest(m.content) IS NOT NULL FROM c
        UNION ALL SELECT 'claude_export', 'attachment', record_id, i, generate_subscripts(m.attachments, 1) - 1, unnest(m.attachments) IS NOT NULL FROM c
        UNION ALL SELECT 'claude_export', 'file', record_id, i, generate_subscripts(m.files, 1) - 1, unnest(m.files) IS NOT NULL FROM c
        UNION ALL SELECT 'grok_export', 'response', record_id, 0, i, r IS NOT NULL FROM g
        UNION ALL SELECT 'grok_export', 'web_result', record_id, i, generate_subscripts(r.response.web_search_results, 1) - 1, unnest(r.response.web_search_results) IS NOT NULL FROM g
        UNION ALL SELECT 'gemini_export', 'html_item', record_id, 0, generate_subscripts(safe_html_item, 1) - 1, unnest(safe_html_item) IS NOT NULL FROM gemini_export
        UNION ALL SELECT 'gemini_export', 'subtitle', record_id, 0, generate_subscripts(subtitles, 1) - 1, unnest(subtitles) IS NOT NULL FROM gemini_export
        UNION ALL SELECT 'gemini_export', 'attached_file', record_id, 0, generate_subscripts(attached_files, 1) - 1, unnest(attached_files) IS NOT NULL FROM gemini_export)
    SELECT source, node, record_id, CAST(p AS INTEGER) AS parent_position, CAST(i AS INTEGER) AS position FROM n WHERE there
    """
)
def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Every node below a record with its parent's position, found from the labels by interval containment."""
    labels = ["record_id", "pre", "post", "position"]
    found = []
    for source, tables in _labelled(spark, d).items():
        for node, parent in _PARENTS[source].items():
            linked = link(tables[node].select(*labels), tables[parent].select(*labels), "record_id", {"parent_position": "position"})
            found.append(linked.select(F.lit(source).alias("source"), F.lit(node).alias("node"), "record_id", "parent_position", "position"))
    return reduce(DataFrame.unionByName, found)


def _values(spark: SparkSession, d: str) -> DataFrame:
    """Every timestamp of the four fields with its place and the zone of its account."""
    none = F.lit(-1)
    claude = exports.read_paths(spark, d, "claude_export", ["record_id", "account_tz", "created_at", "chat_messages.content.start_timestamp"])
    grok = exports.read_paths(spark, d, "grok_export", ["record_id", "account_tz", "conversation.create_time"])
    gemini = exports.read_paths(spark, d, "gemini_export", ["record_id", "account_tz", "time"])
    parts = claude.select("record_id", "account_tz", F.posexplode("chat_messages").alias("message_index", "m")).select(
        "record_id", "account_tz", "message_index", F.posexplode("m.content").alias("part_index", "p")
    )
    shape = lambda df, field, value, mi=none, pi=none: df.select(F.lit(field).alias("field"), "record_id", mi.alias("message_index"), pi.alias("part_index"), value.alias("value"), "account_tz")
    return (
        shape(claude, "claude_created_at", F.col("created_at"))
        .unionByName(shape(parts, "claude_start_timestamp", F.col("p.start_timestamp"), F.col("message_index"), F.col("part_index")))
        .unionByName(shape(grok, "grok_create_time", F.col("conversation.create_time")))
        .unionByName(shape(gemini, "gemini_time", F.col("time")))
    )


@R.query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """UTC instants of all readable values that are not in normal form yet.

    Values in normal form are filtered before the conversion, so the Arrow stage sees only the rest.
    """
    odd = _values(spark, d).where(F.col("value").rlike(r"(?U)\S") & ~F.col("value").rlike(timestamps.NORMAL))
    done = timestamps.normalise(odd, "value", "account_tz").where(F.col("utc_us").isNotNull())
    return done.select("field", "record_id", "message_index", "part_index", "utc_us")


@R.query()
def p5_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Readable values by field and by whether they were normal, with the first and last instant."""
    done = timestamps.normalise(_values(spark, d), "value", "account_tz")
    normal = F.coalesce(F.col("value").rlike(timestamps.NORMAL), F.lit(False))
    return done.groupBy("field", normal.alias("normal")).agg(
        F.count("*").alias("n_values"), F.count("utc_us").alias("n_readable"), F.min("utc_us").alias("first_us"), F.max("utc_us").alias("last_us")
    )
