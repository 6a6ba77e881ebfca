"""Content hashes and derived keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import key_text


def sha256(c: Column) -> Column:
    """Hex SHA-256 of a text."""
    return F.sha2(c, 256)


def memory_key(kind: Column, scope: Column, value: Column, title: Column, body: Column) -> Column:
    """Candidate key of a memory: 32 hex digits over its normalised fields."""
    empty = F.lit("")
    parts = [key_text(kind), scope, key_text(F.coalesce(value, empty)), key_text(F.coalesce(title, empty)), key_text(F.coalesce(body, empty))]
    return F.concat(F.lit("mem:"), F.substring(sha256(F.concat_ws("|", *parts)), 1, 32))


def entity_key(name: Column, kind: Column) -> Column:
    """Candidate key of an entity."""
    return F.concat_ws(":", F.lit("entity"), key_text(name), key_text(kind))


def relationship_key(kind: Column, subject: Column, target: Column) -> Column:
    """Candidate key of a relationship."""
    return F.concat_ws(":", kind, subject, target)


def point_id(c: Column) -> Column:
    """A stable UUID-shaped point id of a text."""
    h = sha256(c)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def conversation_hash(turns: Column) -> Column:
    """Hash of an ordered array of struct<role, at, text>: one line per turn."""
    lines = F.transform(turns, lambda t, i: F.concat(i.cast("string"), F.lit(":"), F.coalesce(t["role"], F.lit("")), F.lit(":"), F.coalesce(t["at"], F.lit("")), F.lit(":"), F.coalesce(t["text"], F.lit("")), F.lit("\n")))
    return sha256(F.array_join(lines, ""))


def document_hash(blocks: Column) -> Column:
    """Hash of an ordered array of struct<kind, text>, NUL-separated."""
    parts = F.transform(blocks, lambda b: F.concat(b["kind"], F.lit("\u0000"), b["text"], F.lit("\u0000")))
    return sha256(F.array_join(parts, ""))


def note_hash(path: Column, content_hash: Column) -> Column:
    """Identity of a note: the same text at two paths is two notes."""
    return sha256(F.concat(path, F.lit("\u0000"), content_hash))
