"""Shapes of the nested chat exports: read schemas and node types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, StructType

from cairn.operators.nested import NodeType, node_tables
from cairn.tables import table

CLAUDE = (
    NodeType(
        "message",
        "chat_messages",
        {"message_uuid": "uuid", "text": "text", "sender": "sender", "message_created_at": "created_at", "message_updated_at": "updated_at"},
        (
            NodeType("part", "content", {"part_type": "type", "part_text": "text", "thinking": "thinking", "start_timestamp": "start_timestamp", "stop_timestamp": "stop_timestamp"}),
            NodeType("attachment", "attachments", {"file_name": "file_name", "file_size": "file_size", "extracted_content": "extracted_content"}),
            NodeType("file", "files", {"file_name": "file_name"}),
        ),
    ),
)
GROK = (
    NodeType(
        "response",
        "responses",
        {
            "response_id": "response._id",
            "conversation_id": "response.conversation_id",
            "message": "response.message",
            "sender": "response.sender",
            "response_created_at": "response.create_time",
            "model": "response.model",
            "share_link": "share_link",
        },
        (NodeType("web_result", "response.web_search_results", {"url": "url", "result_title": "title"}),),
    ),
)
GEMINI = (
    NodeType("html_item", "safe_html_item", {"html": "html"}),
    NodeType("subtitle", "subtitles", {"name": "name", "url": "url"}),
    NodeType("attached_file", "attached_files", {"file_name": "name"}),
)

CLAUDE_RECORD = {"uuid": "uuid", "name": "name", "summary": "summary", "created_at": "created_at", "updated_at": "updated_at"}
GROK_RECORD = {"id": "conversation.id", "title": "conversation.title", "summary": "conversation.summary", "create_time": "conversation.create_time"}
GEMINI_RECORD = {"title": "title", "time": "time", "image_file": "image_file"}


def claude_nodes(df: DataFrame) -> dict[str, DataFrame]:
    """conversation, message, part, attachment and file tables of flat chat exports."""
    return node_tables(df, ["record_id"], CLAUDE, "conversation", {k: v for k, v in CLAUDE_RECORD.items() if v in df.columns})


def grok_nodes(df: DataFrame) -> dict[str, DataFrame]:
    """envelope, response and web_result tables of envelope exports."""
    return node_tables(df, ["record_id"], GROK, "envelope", GROK_RECORD)


def gemini_nodes(df: DataFrame) -> dict[str, DataFrame]:
    """activity, html_item, subtitle and attached_file tables of activity logs."""
    return node_tables(df, ["record_id"], GEMINI, "activity", GEMINI_RECORD)


def narrow(schema: StructType, paths: list[str]) -> StructType:
    """The part of a schema that holds the given dotted paths, through arrays.

    Handing it to the reader makes the Parquet scan read only those leaves, also where a path runs
    through arrays of arrays, which the planner's own nested pruning does not follow.
    """
    wanted: dict[str, list[str]] = {}
    for path in paths:
        head, _, rest = path.partition(".")
        wanted.setdefault(head, []).append(rest)
    out = StructType()
    for f in schema.fields:
        if f.name not in wanted:
            continue
        rests = [r for r in wanted[f.name] if r]
        kind = f.dataType
        if rests:
            if isinstance(kind, ArrayType):
                kind = ArrayType(narrow(kind.elementType, rests), kind.containsNull)
            else:
                kind = narrow(kind, rests)
        out = out.add(f.name, kind, f.nullable)
    return out


def read_paths(spark: SparkSession, directory: str, name: str, paths: list[str]) -> DataFrame:
    """A table with only the leaves named by ``paths``."""
    schema = narrow(table(spark, directory, name).schema, paths)
    return spark.read.schema(schema).parquet(f"{directory}/{name}.parquet")
