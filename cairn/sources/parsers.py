"""Parsers of exported files and notes into flat rows.

Parsing one file, note or conversation is sequential by nature, so it runs in Arrow batches next to
the data; everything that only rearranges columns stays in DataFrame expressions.  A record that
cannot be parsed yields a row with ``error`` and nothing else, so a bad file never fails a job.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- HTML -------------------------------------------------------------------------------------

# Tags that break a line, by prefix; the entities that are decoded.
_BREAKS = ("<br", "</p", "</div", "</li", "</tr", "</h1", "</h2", "</h3", "</h4", "</h5", "</h6", "</blockquote", "<hr")
_ENTITIES = {"&quot;": '"', "&#39;": "'", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&nbsp;": " "}
_MARKUP = re.compile(r"<[^>]*>|" + "|".join(map(re.escape, _ENTITIES)))


def _plain(match: re.Match) -> str:
    token = match.group()
    if token[0] == "&":
        return _ENTITIES[token]
    return "\n" if token.startswith(_BREAKS) else "- " if token.startswith("<li") else ""


def html_to_text(html: str | None) -> str | None:
    """Text of a fragment: block ends become lines, items get a dash, other tags go, entities are decoded once."""
    if html is None:
        return None
    lines = (" ".join(line.split()) for line in _MARKUP.sub(_plain, html).splitlines())
    return "\n".join(line for line in lines if line)


def html_text(c: Column) -> Column:
    """:func:`html_to_text` of a column, in Arrow batches."""

    @F.pandas_udf(StringType())
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(html_to_text, na_action="ignore")

    return run.asNondeterministic()(c)  # a filter on the result must not evaluate it again


# --- plain text and Markdown --------------------------------------------------------------------


def plain_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, block_no, block)``: paragraphs set apart by blank lines; blank ones are left out."""
    parts = F.filter(F.transform(F.split(F.col(text), "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return df.select(key, F.posexplode(parts).alias("block_no", "block"))


_HEADING = re.compile(r"(#{1,6})\s+(.*\S)")
_ITEM = re.compile(r"(?:[-*+]|\d+[.)])\s")


def markdown_blocks(text: str | None) -> list[tuple[int, str, int | None, str, list[str]]]:
    """``(block_no, kind, level, text, heading path)`` of a Markdown text.

    Lines are classed one by one; runs of one class make a block.  A heading is a block of its own
    and sets the path of what follows; a fence runs to its end or that of the text.
    """
    classed: list[tuple[str, str]] = []
    fenced = False
    for line in (text or "").splitlines():
        bare = line.strip()
        if bare.startswith("```"):
            fenced = not fenced
            classed.append(("fence", ""))
        elif fenced:
            classed.append(("code", line))
        elif not bare:
            classed.append(("blank", ""))
        elif _HEADING.fullmatch(bare):
            classed.append(("heading", bare))
        elif _ITEM.match(bare):
            classed.append(("list", bare))
        else:
            classed.append(("paragraph", line))
    out: list[tuple[int, str, int | None, str, list[str]]] = []
    path: list[str] = []
    for kind, run in groupby(classed, key=lambda c: c[0]):
        lines = [line for _, line in run]
        if kind == "heading":
            for line in lines:
                marks, title = _HEADING.fullmatch(line).groups()
                path = [*path[: len(marks) - 1], title]
                out.append((len(out), kind, len(marks), title, path))
        elif kind in ("paragraph", "list", "code") and (body := "\n".join(lines).strip("\n")).strip():
            out.append((len(out), kind, None, body if kind == "code" else body.strip(), path))
    return out


def markdown_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """Markdown blocks of all rows."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, block_no int, kind string, level int, block string, heading_path array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *block) for k, t in zip(batch[key], batch[text]) for block in markdown_blocks(t)]
            out = pd.DataFrame(rows, columns=[key, "block_no", "kind", "level", "block", "heading_path"])
            out["level"] = out["level"].astype("Int32")
            yield out

    return df.select(key, text).mapInPandas(run, schema)


# --- notes --------------------------------------------------------------------------------------

_FRONT = re.compile(r"\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)", re.S)
_PROPERTY = re.compile(r"([A-Za-z_][\w -]*):[ \t]*(.*)")
_WIKI = re.compile(r"(!?)\[\[([^\[\]\n]+)\]\]")
_LINK = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\(((?:[^()\s\\]|\\.|\([^()]*\))+)\)")
_TAG = re.compile(r"(?:^|(?<=[\s(\[{]))#([A-Za-z0-9_/-]+)")
_TEMPLATE = ("${", "<%", "%>", "{{")
# Extensions of attachments.
ATTACHMENTS = frozenset("avif base bmp canvas csv doc docx epub gif heic jpeg jpg m4a mdx mov mp3 mp4 ogg pdf png ppt pptx svg txt wav webm webp xls xlsx zip".split())


def _kind(value: str) -> str:
    if value in ("", "null", "~"):
        return "null"
    if value in ("true", "false"):
        return "bool"
    if re.fullmatch(r"-?\d+(?:\.\d+)?", value):
        return "number"
    if value.startswith("["):
        return "list"
    if value.startswith("{"):
        return "json"
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        return "date"
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*", value):
        return "datetime"
    return "string"


def _listed(value: str, by: str) -> list[str]:
    return [v.strip().strip("\"'") for v in re.split(by, value.strip().strip("[]")) if v.strip().strip("\"'")]


def normal_path(path: str, base: str = "") -> str:
    """A note path without ``.`` and ``..``, relative ones below ``base``."""
    parts: list[str] = [] if path.startswith("/") or not base else base.split("/")
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            parts = parts[:-1]
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


def _target(raw: str) -> tuple[str, str | None, str | None]:
    """Path, heading and block of a link target."""
    path, _, anchor = raw.partition("#")
    if anchor.startswith("^"):
        return path.strip(), None, anchor[1:].strip()
    return path.strip(), anchor.strip() or None, None


def vault_target(uri: str) -> str | None:
    """The note path inside a vault that an application or file address names; None for other addresses.

    ``obsidian://open?vault=v&file=a%2Fb`` names ``a/b.md``; ``file:///x/a/b.md`` its path.
    """
    from urllib.parse import parse_qs, unquote, urlsplit

    try:
        parts = urlsplit(uri)
    except ValueError:
        return None
    if parts.scheme == "obsidian" and parts.netloc == "open":
        named = parse_qs(parts.query).get("file", [""])[0]
        return ensure_note(named) if named.strip() else None
    if parts.scheme == "file":
        return unquote(parts.path).lstrip("/") or None
    return None


def ensure_note(path: str) -> str:
    """A note path with its extension; paths that have one, and anchors, stay."""
    name, mark, anchor = path.strip().partition("#")
    last = name.rpartition("/")[2]
    return (name if not last or "." in last.strip(".") else f"{name}.md") + mark + anchor


def stem(path: str) -> str:
    """The last part of a path without its note extension, in lower case."""
    last = path.replace("\\", "/").rpartition("/")[2]
    return re.sub(r"\.(?:md|markdown)$", "", last, flags=re.I).lower()


def _class_of(target: str) -> str:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", target):
        inner = vault_target(target)
        return _class_of(inner) if inner else "external"
    path, heading, block = _target(target)
    base, _, extension = path.rpartition("/")[2].rpartition(".")
    return "attachment" if base and extension.lower() in ATTACHMENTS else "block" if block else "heading" if heading else "note"


def parse_note(path: str, text: str) -> dict:
    """Properties, tags, aliases, links and title of one note."""
    front = _FRONT.match(text)
    body = text[front.end() :] if front else text
    properties, tags, aliases = [], [], []
    key = None
    for line in front.group(1).splitlines() if front else ():
        if (item := re.match(r"\s+-\s+(.*)", line)) and key:
            (tags if key == "tags" else aliases if key == "aliases" else []).append(item.group(1).strip().strip("\"'"))
        elif m := _PROPERTY.match(line):
            key, value = m.group(1).strip().lower(), m.group(2).strip()
            if key in ("tags", "tag"):
                key = "tags"
                tags += _listed(value, r"[,\s]+")
            elif key in ("aliases", "alias"):
                key = "aliases"
                aliases += _listed(value, ",")
            properties.append({"name": m.group(1).strip(), "value": value, "kind": _kind(value)})
    links, fenced = [], False
    title = next((p["value"].strip("\"'") for p in properties if p["name"].lower() == "title" and p["value"]), None)
    for line in body.splitlines():
        if line.strip().startswith("```"):
            fenced = not fenced
            continue
        if fenced:
            continue
        if title is None and (h := _HEADING.fullmatch(line.strip())):
            title = h.group(2)
        if any(t in line for t in _TEMPLATE):
            continue
        taken = []
        for m in _WIKI.finditer(line):
            target, _, shown = m.group(2).partition("|")
            taken.append(m.span())
            links.append({"kind": "embed" if m.group(1) else "wikilink", "raw_target": target.strip(), "display_text": shown.strip() or None, "target_kind": _class_of(target.strip()), "target_path": _target(target)[0]})
        for m in _LINK.finditer(line):
            if not any(a <= m.start() < b for a, b in taken):
                target = re.sub(r"\\(.)", r"\1", m.group(3))
                links.append({"kind": "embed" if m.group(1) else "markdown", "raw_target": target, "display_text": m.group(2) or None, "target_kind": _class_of(target), "target_path": None if _class_of(target) == "external" else normal_path(_target(target)[0], path.rpartition("/")[0])})
        if not _HEADING.fullmatch(line.strip()):
            tags += [m.group(1) for m in _TAG.finditer(line)]
    clean = lambda t: "/".join(p for p in (x.strip() for x in t.strip().lstrip("#").lower().split("/")) if p)
    return {
        "path": path,
        "title": title or path.rpartition("/")[2].removesuffix(".md"),
        "tags": list(dict.fromkeys(t for t in map(clean, tags) if t)),
        "aliases": list(dict.fromkeys(" ".join(a.split()) for a in aliases)),
        "properties": properties,
        "links": links,
        "body": body.strip() or text.strip(),
    }


NOTE = """path string, title string, tags array<string>, aliases array<string>, properties array<struct<name string, value string, kind string>>,
links array<struct<kind string, raw_target string, display_text string, target_kind string, target_path string>>, body string, error string"""
MAX_NOTES, MAX_BYTES = 10_000, 64 << 20


def _note_rows(notes: Iterator[tuple[str, bytes]]) -> list[dict]:
    rows = []
    for path, data in notes:
        hidden = any(part.startswith(".") for part in path.split("/"))
        if hidden or not path.lower().endswith(".md"):
            continue
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError as bad:
            rows.append({"path": path, "error": str(bad)})
            continue
        if text.strip():
            rows.append(parse_note(path, text))
    return sorted(rows, key=lambda r: r["path"])


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = ["path", "title", "tags", "aliases", "properties", "links", "body", "error"]
    return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)


def vault_zips(spark: SparkSession, pattern: str) -> DataFrame:
    """Notes of zipped vaults; a vault over the limits, or no zip, is one row with an error."""
    files = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("_file"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["_file"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        infos = [i for i in z.infolist() if i.filename.lower().endswith(".md")]
                        if len(infos) > MAX_NOTES or sum(i.file_size for i in infos) > MAX_BYTES:
                            raise ValueError("vault exceeds the limits")
                        yield _frame(_note_rows((i.filename, z.read(i)) for i in infos))
                except (zipfile.BadZipFile, ValueError) as bad:
                    yield _frame([{"path": name, "error": str(bad)}])

    return files.mapInPandas(run, NOTE)


def vault_directory(spark: SparkSession, root: str) -> DataFrame:
    """Notes of a vault directory with their times of modification, read recursively by all executors.

    Application folders (names that begin with a dot) are skipped.  A vault over the limits of notes
    or bytes is one row with an error, found from the listing before a note is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", ""), "^" + re.escape(base) + "/", "")
    listed = files.select(relative.alias("path"), "content", "length", F.unix_micros("modificationTime").alias("modified_us")).where(~F.col("path").rlike(r"(^|/)\."))
    count, size = listed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    schema = NOTE.rstrip() + ", modified_us long"
    if count > MAX_NOTES or size > MAX_BYTES:
        return spark.createDataFrame([{"path": root, "error": "vault exceeds the limits"}], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = _frame(_note_rows(zip(batch["path"], batch["content"])))
            yield frame.merge(batch[["path", "modified_us"]], on="path", how="left")

    return listed.select("path", "content", "modified_us").mapInPandas(run, schema)


def dispatch(name: str, data: bytes | None = None, names: list[str] | None = None) -> str | None:
    """How a file or folder is imported: by its extension, by what a folder or zip holds, else by its payload.

    ``names`` are a folder's or zip's entries.  None: not importable.
    """
    low = name.lower()
    if names is not None:
        if any(n == ".obsidian" or n.startswith(".obsidian/") or "/.obsidian/" in n for n in names):
            return "obsidian_vault"
        if any(n.lower().endswith("conversations.json") for n in names):
            return "chatgpt_export"
        return "obsidian_vault" if any(n.lower().endswith(".md") for n in names) else None
    if low.endswith((".md", ".markdown")):
        return "markdown_file"
    if low.endswith(".txt"):
        return "text_file"
    if data is not None and low.endswith((".json", ".zip", ".html")):
        found = sniff(data)
        return {"chatgpt": "chatgpt_export", "claude": "claude_export", "grok": "grok_export", "gemini": "gemini_takeout"}.get(found)
    return None


# --- tree-shaped chat exports -------------------------------------------------------------------


def active_path(conversation: dict) -> list[dict]:
    """The nodes of the active branch, root first; raises ValueError on a malformed tree.

    With a current node, the chain of its parents; otherwise from the root the child with the latest
    message time, then the last one in the list.
    """
    mapping = conversation.get("mapping") or {}
    if not mapping:
        raise ValueError("empty conversation")
    current = conversation.get("current_node")
    seen: set[str] = set()
    path: list[dict] = []
    if current is not None:
        while current is not None:
            if current not in mapping:
                raise ValueError(f"missing node {current}")
            if current in seen:
                raise ValueError("cyclic tree")
            seen.add(current)
            path.append(mapping[current])
            current = mapping[current].get("parent")
        return path[::-1]
    roots = [k for k, n in mapping.items() if n.get("parent") is None]
    if not roots:
        raise ValueError("no root")
    current = roots[0]
    while current is not None:
        if current in seen:
            raise ValueError("cyclic tree")
        seen.add(current)
        node = mapping[current]
        path.append(node)
        children = node.get("children") or []
        if missing := [c for c in children if c not in mapping]:
            raise ValueError(f"missing child {missing[0]}")
        times = [((mapping[c].get("message") or {}).get("create_time"), i, c) for i, c in enumerate(children)]
        current = max(times, key=lambda t: (t[0] is not None, t[0] or 0.0, t[1]))[2] if times else None
    return path


TREE = "conversation_id string, title string, message_no int, node_id string, role string, author string, create_time double, text string, skipped array<string>, error string"
_ROLES = {"system", "user", "assistant", "tool"}


def _tree_rows(conversation: dict) -> list[tuple]:
    ident, title = conversation.get("id") or conversation.get("conversation_id"), conversation.get("title")
    try:
        nodes = active_path(conversation)
    except ValueError as bad:
        return [(ident, title, None, None, None, None, None, None, None, str(bad))]
    rows: list[list] = []
    pending: list[str] = []
    for node in nodes:
        message = node.get("message")
        if not message:
            continue
        content = message.get("content") or {}
        kind, parts = content.get("content_type"), content.get("parts") or []
        if kind in ("text", "code", "multimodal_text"):
            text = "".join(p for p in parts if isinstance(p, str))
            skipped = [(p.get("content_type") or ("asset_pointer" if "asset_pointer" in p else "unknown")) if isinstance(p, dict) else "unknown" for p in parts if not isinstance(p, str) and p is not None]
        else:
            text, skipped = "", [str(kind)]
        if not text.strip():
            pending += skipped  # what a silent node skipped belongs to the next message
            continue
        author = message.get("author") or {}
        role = author.get("role") if author.get("role") in _ROLES else "unknown"
        rows.append([ident, title, len(rows), node.get("id"), role, author.get("name"), message.get("create_time"), text, pending + skipped, None])
        pending = []
    if pending and rows:
        rows[-1][8] = rows[-1][8] + pending
    return [tuple(r) for r in rows]


def tree_exports(files: DataFrame) -> DataFrame:
    """Messages of tree-shaped exports; ``files`` has ``content`` (bytes of a JSON array or of a zip holding one)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for data in batch["content"]:
                try:
                    if data[:4] == b"PK\x03\x04":
                        with zipfile.ZipFile(io.BytesIO(data)) as z:
                            names = z.namelist()
                            name = next((n for n in names if n == "conversations.json"), None) or next((n for n in names if n.rsplit("/", 1)[-1] == "conversations.json"), None)
                            if name is None:
                                raise ValueError("no conversations.json in the archive")
                            data = z.read(name)
                    for conversation in json.loads(data):
                        rows += _tree_rows(conversation)
                except (ValueError, zipfile.BadZipFile) as bad:
                    rows.append((None,) * 9 + (str(bad),))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in TREE.split(", ")])
            out["message_no"] = out["message_no"].astype("Int32")
            yield out

    return files.select("content").mapInPandas(run, TREE)


def sniff(data: bytes) -> str | None:
    """Which export a payload is: ``chatgpt``, ``claude``, ``grok``, ``gemini``, or None."""
    if data[:4] == b"PK\x03\x04":
        return "chatgpt"
    try:
        value = json.loads(data)
    except ValueError:
        return None
    if isinstance(value, dict):
        return "grok" if isinstance(value.get("conversations"), list) else None
    first = next((v for v in value if isinstance(v, dict)), {}) if isinstance(value, list) else {}
    for name, mark in (("chatgpt", "mapping"), ("claude", "chat_messages"), ("gemini", "header"), ("gemini", "safeHtmlItem")):
        if mark in first:
            return name
    return None
