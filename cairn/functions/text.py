"""Scalar text functions as column builders; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical entity types and the normalised names that map to them.
ENTITY_TYPES = {
    "brand": ("brand", "organization brand"),
    "organization": ("organization", "company", "retailer", "store"),
    "food_product": ("food product", "food product or source", "food source", "product or ingredient"),
    "supplement_form": ("supplement form", "supplement"),
    "biomarker": ("laboratory marker", "biomarker"),
    "training_type": ("exercise program", "training type", "exercise type"),
    "medication": ("medication", "medication or brand name mention"),
    "quality_standard": ("quality standard",),
}
# Normalised names that are no entities, at all or for a type.
GENERIC_LABELS = ("user", "assistant", "human", "lineage", "supersession", "queue", "architecture", "system", "project")
SPEAKERS = ("", "the", "claude", "chatgpt", "gemini", "grok", "ai", "llm", "model")
PLACEHOLDER_NAMES = ("translation", "translations", "language setting", "language settings", "color scheme", "desktop", "general", "settings")
ROLES = {"human": "user", "user": "user", "assistant": "assistant", "system": "system", "tool": "tool"}


def key_text(c: Column) -> Column:
    """Normalised key text: lower case, runs of anything but ASCII letters and digits to one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def ascii_text(c: Column) -> Column:
    """As :func:`key_text`, but characters are dropped before, not after, they are lower-cased."""
    return F.trim(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")))


def phrase(c: Column) -> Column:
    """Trimmed and in lower case."""
    return F.lower(F.trim(c))


def singular(token: Column) -> Column:
    """Crude singular of a token of more than four letters: -ies to -y, trailing -s (not -ss) off."""
    size = F.length(token)
    return (
        F.when((size > 4) & token.endswith("ies"), F.concat(F.left(token, size - 3), F.lit("y")))
        .when((size > 4) & token.endswith("s") & ~token.endswith("ss"), F.left(token, size - 1))
        .otherwise(token)
    )


def tokens(c: Column) -> Column:
    """Distinct singular tokens of the normalised text (empty array for none)."""
    parts = F.filter(F.split(key_text(F.coalesce(c, F.lit(""))), " "), lambda t: t != "")
    return F.array_distinct(F.transform(parts, singular))


def merge_text(c: Column) -> Column:
    """The normalised text with every token in the singular."""
    return F.array_join(F.transform(F.split(key_text(F.coalesce(c, F.lit(""))), " "), singular), " ")


def overlap_score(a: Column, b: Column) -> Column:
    """1 for equal or contained texts, 0 with an empty one, else shared over the smaller token set."""
    x, y = merge_text(a), merge_text(b)
    tx, ty = tokens(a), tokens(b)
    shared = F.size(F.array_intersect(tx, ty)).cast("double")
    return F.when((x == "") | (y == ""), 0.0).when(x.contains(y) | y.contains(x), 1.0).otherwise(shared / F.least(F.size(tx), F.size(ty)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def entity_type(c: Column) -> Column:
    """Canonical entity type; unknown ones with underscores for blanks, blank ones ``entity``."""
    plain = key_text(F.coalesce(c, F.lit("")))
    out = F.when(plain == "", "entity")
    for name, words in ENTITY_TYPES.items():
        out = out.when(plain.isin(*words), name)
    return out.otherwise(F.regexp_replace(plain, " ", "_"))


def is_entity(name: Column, kind: Column) -> Column:
    """False for blank and path-like names, generic labels, speakers and placeholders."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    key, of = key_text(raw), key_text(F.coalesce(kind, F.lit("")))
    pathlike = raw.startswith(".") | raw.contains("/") | raw.contains("\\")
    speaker = of.isin("person", "entity") & key.rlike(f"^(?:{'|'.join(SPEAKERS)}) (?:user|assistant)$")
    placeholder = of.isin("concept", "entity") & key.isin(*PLACEHOLDER_NAMES)
    return (key != "") & ~pathlike & ~key.isin(*GENERIC_LABELS) & ~speaker & ~placeholder


def confidence_rank(c: Column) -> Column:
    """high 3, medium 2, low 1, anything else 0."""
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def confidence_label(score: Column) -> Column:
    """The label of a score."""
    return F.when(score.isNull(), None).when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def role(sender: Column) -> Column:
    """Participant role of a sender name in any case; ``unknown`` otherwise."""
    name = F.lower(F.coalesce(sender, F.lit("")))
    out = F.lit("unknown")
    for key, value in ROLES.items():
        out = F.when(name == key, value).otherwise(out)
    return out


def tag(c: Column) -> Column:
    """Normalised tag: no leading #, lower case, no empty path parts."""
    bare = F.regexp_replace(F.lower(F.trim(c)), "^#+", "")
    return F.array_join(F.filter(F.transform(F.split(bare, "/"), lambda p: F.trim(p)), lambda p: p != ""), "/")


def alias(c: Column) -> Column:
    """Normalised alias: white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def shorten(c: Column, limit: int, mark: str = "...") -> Column:
    """The text cut to ``limit`` characters, with a mark where something was cut."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(mark))).otherwise(c)


def inline_tags(line: Column) -> Column:
    """Normalised inline #tags of a line in order, first occurrence only."""
    found = F.regexp_extract_all(line, F.lit(r"(?:^|[\s(\[{])(#[A-Za-z0-9_/-]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, tag), lambda t: t != ""))


def strip_render_tags(c: Column) -> Column:
    """Text without inline render tags, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"<(/?)(grok:render|xai:)[^>]*>", ""))


def like_literal(text: str) -> str:
    """A user's text for LIKE, with its wildcards taken literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into an ASCII letter and marks, and that letter."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and d[0].isalpha()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def folded(c: Column) -> Column:
    """A text in lower case without the marks of Latin letters; null stays null."""
    return F.translate(F.lower(c), *_accents())


def fold(value: str) -> str:
    """The same for a text on the driver."""
    return value.lower().translate(str.maketrans(*_accents()))
