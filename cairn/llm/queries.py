"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import durable
from cairn.llm import components, conversations, history, identity, leaks, packing, sentences, splitting
from cairn.operators import timestamps
from cairn.plans.registry import Registry
from cairn.sources import exports
from cairn.tables import table

R = Registry()


def registries() -> list[Registry]:
    """The registries of this package."""
    return [R]


@R.query(
    sql="""
    WITH RECURSIVE e AS (
        SELECT DISTINCT source_object_id AS a, target_object_id AS b FROM oa_archive_link
        WHERE link_type = 'same_as' AND source_object_id IS NOT NULL AND target_object_id IS NOT NULL AND source_object_id <> target_object_id),
    s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a, a AS b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)
    SELECT a AS derived_object_id, min(b) AS group_id FROM r GROUP BY a
    """
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every object with a ``same_as`` link to another object."""
    links = table(spark, d, "oa_archive_link").where(F.col("link_type") == "same_as")
    return components.connected_components(links, "source_object_id", "target_object_id", "derived_object_id", "group_id")


@R.query()
def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all oversized segments."""
    return splitting.split_table(table(spark, d, "oa_segment"), ["segment_id"], "text_content")


@R.query(sql="SELECT DISTINCT segment_id FROM oa_segment WHERE octet_length(encode(text_content)) > 4000")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Segments that had to be split."""
    return p4_pieces(spark, d).where(F.col("n_pieces") > 1).select("segment_id").distinct()


def _messages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Message rows with text of both chat exports, and the conversations that records name."""
    full = r"(?U)\S"
    claude = exports.read_paths(
        spark, d, "claude_export",
        ["record_id", "uuid", *(f"chat_messages.{p}" for p in ("uuid", "text", "sender", "created_at", "content.type", "content.text"))],
    )
    grok = exports.read_paths(
        spark, d, "grok_export",
        ["record_id", "conversation.id", *(f"responses.response.{p}" for p in ("_id", "conversation_id", "message", "sender", "create_time"))],
    )
    said = F.exists("m.content", lambda p: (p["type"] == "text") & p["text"].rlike(full))
    a = (
        claude.select("record_id", F.col("uuid").alias("conversation_id"), F.posexplode("chat_messages").alias("i", "m"))
        .where(F.coalesce(said, F.lit(False)) | F.coalesce(F.col("m.text").rlike(full), F.lit(False)))
        .select(F.lit("claude_export").alias("source"), "conversation_id", F.col("m.uuid").alias("message_id"), "m.sender", F.col("m.created_at").alias("at"), F.struct("record_id", "i").alias("pos"))
    )
    bare = F.regexp_replace("r.message", r"<(/?)(grok:|xai:)[^>]*>", "")
    b = (
        grok.select("record_id", F.col("conversation.id").alias("envelope"), F.posexplode("responses").alias("i", "x"))
        .select("record_id", "envelope", "i", F.col("x.response").alias("r"))
        .where(bare.rlike(full))
        .select(F.lit("grok_export").alias("source"), F.coalesce("r.conversation_id", "envelope").alias("conversation_id"), F.col("r._id").alias("message_id"), "r.sender", F.col("r.create_time").alias("at"), F.struct("record_id", "i").alias("pos"))
    )
    both = a.unionByName(b)
    quick = timestamps.instant(F.col("at"))
    slow = timestamps.utc_micros(F.when(quick.isNull(), F.col("at")), F.lit(None).cast("string"))
    named = claude.select(F.lit("claude_export").alias("source"), F.col("uuid").alias("conversation_id")).unionByName(
        grok.select(F.lit("grok_export").alias("source"), F.col("conversation.id").alias("conversation_id"))
    )
    # conversations that only responses without text name are judged as well
    silent = grok.select("conversation.id", F.explode("responses").alias("x")).select(F.lit("grok_export").alias("source"), F.coalesce("x.response.conversation_id", "id").alias("conversation_id"))
    return both.withColumn("t", F.coalesce(quick, slow)).drop("at"), named, silent


@R.query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Conversations to drop."""
    messages, named, silent = _messages(spark, d)
    return conversations.rebuild(messages, named, mentioned=silent).rejected().select("source", "conversation_id")


@R.query()
def p7_turns(spark: SparkSession, d: str) -> DataFrame:
    """Ordered turns of the conversations that are kept."""
    messages, named, silent = _messages(spark, d)
    return conversations.rebuild(messages, named, mentioned=silent).turns()


@R.query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that repeat an accepted row, batch after batch, each with that row."""
    raw = exports.read_paths(spark, d, "claude_export", ["record_id", "batch_no", "uuid", "updated_at", "chat_messages.text"])
    rows = raw.select("record_id", "batch_no", F.xxhash64("uuid").alias("owner"), timestamps.instant(F.col("updated_at")).alias("updated"), F.col("chat_messages.text").alias("texts"))
    return history.deduplicate(rows)


@R.query()
def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Leaked passages with the number of their words and their place in the document."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"), "doc_id", "text")


@R.query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that carry a passage, each with the items it leaks."""
    return p9_spans(spark, d).select("doc_id", "item_id")


@R.query()
def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """All sentences of all documents with their place."""
    return sentences.sentence_table(table(spark, d, "documents"), "doc_id", "text", "lang")


@R.query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The first character of every sentence."""
    return p10_sentences(spark, d).select("doc_id", "start_char")


def _personal(spark: SparkSession, d: str) -> DataFrame:
    """Every text that may carry personal information, with its place."""
    claude = exports.read_paths(spark, d, "claude_export", ["record_id", "chat_messages.text"])
    said = claude.select(F.lit("claude_export").alias("source"), "record_id", F.posexplode("chat_messages.text").alias("message_index", "text"))
    other = lambda name, column: table(spark, d, name).select(F.lit(name).alias("source"), F.col("row_id").alias("record_id"), F.lit(-1).alias("message_index"), F.col(column).alias("text"))
    return said.unionByName(other("worker_hardening", "text")).unionByName(other("durable_health_history", "body_text")).where("text is not null")


_PLACE = ["source", "record_id", "message_index"]


@R.query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every mention with its type and place."""
    return identity.mentions(_personal(spark, d), _PLACE, "text").select(*_PLACE, "pii_type", "start_char")


@R.query()
def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with placeholders for mentions."""
    texts = _personal(spark, d)
    return identity.redact(texts, _PLACE, "text", identity.mentions(texts, _PLACE, "text"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of all documents, stored once so that no later stage tokenises again."""
    sized = packing.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text"), "text")
    return durable.Workspace(spark, "packing").cut(sized.select("doc_id", "source", "n_tokens"), "sizes")


#: The mixture that training windows are to have, by source, in tokens.
MIXTURE = {
    "chatgpt_export": 0.30, "claude_export": 0.12, "gemini_takeout": 0.08, "grok_export": 0.10,
    "markdown_file": 0.18, "obsidian_vault": 0.12, "text_file": 0.10,
}


@R.query()
def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in its container, sources mixed by :data:`MIXTURE` while all of them last."""
    return packing.pack(_sized(spark, d), "doc_id", "source", "n_tokens", MIXTURE)


@R.query()
def p8_own_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The same in the proportions that the sources have themselves."""
    return packing.pack(_sized(spark, d), "doc_id", "source", "n_tokens")


@R.query()
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The containers with their fill."""
    return p8_packed(spark, d).groupBy("lane", "window").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").cast("long").alias("n_tokens"))


@R.query()
def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each source in each lane, against the target; lanes after the first are of what was left over."""
    packed = p8_packed(spark, d)
    sums = packed.groupBy("lane", "source").agg(F.sum("n_tokens").cast("long").alias("n_tokens"))
    total = sums.groupBy("lane").agg(F.sum("n_tokens").alias("lane_tokens"))
    target = F.create_map(*(F.lit(x) for pair in MIXTURE.items() for x in pair))
    return sums.join(total, "lane").select("lane", "source", "n_tokens", F.round(F.col("n_tokens") / F.col("lane_tokens"), 4).alias("share"), F.coalesce(target[F.col("source")], F.lit(0.0)).alias("target"))
