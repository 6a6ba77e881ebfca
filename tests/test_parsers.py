import io
import json
import zipfile

import pytest

from cairn.sources import parsers


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>One &amp; two</p><p>three<br>four</p>", "One & two\nthree\nfour"),
        ("<ul><li>a</li><li> b  c</li></ul>", "- a\n- b c"),
        ("&amp;lt; x &nbsp;y &#39;q&#39; &unknown;", "&lt; x y 'q' &unknown;"),
        ("<script>kept()</script> a < b", "kept() a < b"),
        ("<h2>T</h2><hr><blockquote>q</blockquote>z", "T\nq\nz"),
        ("", ""),
        (None, None),
    ],
)
def test_html(html, text):
    assert parsers.html_to_text(html) == text


def test_markdown():
    text = "# Title\n\nParagraph text.\nmore\n- one\n- two\n\n## Sub\ntext\n### Deep\n# Other\n```\ncode\n\n# no heading\n```\n1. x\n"
    rows = parsers.markdown_blocks(text)
    assert [(k, b) for _, k, _, b, _ in rows] == [("heading", "Title"), ("paragraph", "Paragraph text.\nmore"), ("list", "- one\n- two"), ("heading", "Sub"), ("paragraph", "text"), ("heading", "Deep"), ("heading", "Other"), ("code", "code\n\n# no heading"), ("list", "1. x")]
    assert rows[4][4] == ["Title", "Sub"] and rows[5][4] == ["Title", "Sub", "Deep"] and rows[7][4] == ["Other"]
    assert parsers.markdown_blocks(None) == [] and parsers.markdown_blocks("```\nopen") == [(0, "code", None, "open", [])]


def test_note():
    text = "---\ntitle: \"My note\"\ntags: [Work/Sub, two]\naliases: A b , c\nstatus: 3\ndue: 2024-01-02\n---\n# Head\nSee [[Projects/Acme#Plan|Acme]] and ![[pic.png]] #todo/Item x#no\n[site](https://e.com/a(b)) [up](../x.md)\n```\n#notag [[no]]\n```\n${tpl} [[skip]]\n"
    note = parsers.parse_note("dir/n.md", text)
    assert note["title"] == "My note" and note["tags"] == ["work/sub", "two", "todo/item"] and note["aliases"] == ["A b", "c"]
    assert {p["name"]: p["kind"] for p in note["properties"]} == {"title": "string", "tags": "list", "aliases": "string", "status": "number", "due": "date"}
    assert [(x["kind"], x["target_kind"], x["raw_target"], x["target_path"]) for x in note["links"]] == [
        ("wikilink", "heading", "Projects/Acme#Plan", "Projects/Acme"), ("embed", "attachment", "pic.png", "pic.png"), ("markdown", "external", "https://e.com/a(b)", None), ("markdown", "note", "../x.md", "x.md"),
    ]
    assert parsers.parse_note("Inbox.md", "text")["title"] == "Inbox"


def node(i, parent, children=(), role="user", parts=("x",), at=1.0, kind="text", message=True):
    m = {"author": {"role": role}, "create_time": at, "content": {"content_type": kind, "parts": list(parts)}} if message else None
    return {"id": i, "parent": parent, "children": list(children), "message": m}


def test_tree_paths():
    tree = {n["id"]: n for n in [node("r", None, ["a", "b"], message=False), node("a", "r", at=5.0), node("b", "r", ["c"], at=9.0), node("c", "b", at=None)]}
    assert [n["id"] for n in parsers.active_path({"mapping": tree})] == ["r", "b", "c"]
    assert [n["id"] for n in parsers.active_path({"mapping": tree, "current_node": "a"})] == ["r", "a"]
    tree["b"]["message"]["create_time"] = None
    assert [n["id"] for n in parsers.active_path({"mapping": tree})] == ["r", "a"]
    for bad in ({}, {"mapping": tree, "current_node": "zz"}, {"mapping": {"x": node("x", "y"), "y": node("y", "x")}}, {"mapping": {"x": node("x", "y"), "y": node("y", "x")}, "current_node": "x"}, {"mapping": {"x": node("x", None, ["gone"])}}):
        with pytest.raises(ValueError):
            parsers.active_path(bad)


def test_tree_exports(spark, tmp_path):
    mapping = {n["id"]: n for n in [node("r", None, ["t"], "system", ["sys"]), node("t", "r", ["u"], "tool", ["p"], kind="execution_output"), node("u", "t", ["v"], "user", ["see ", {"content_type": "image"}, "this"], kind="multimodal_text"), node("v", "u", [], "assistant", ["end"])]}
    payload = json.dumps([{"id": "c1", "title": "T", "mapping": mapping}, {"id": "c2", "mapping": {}}]).encode()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("export/conversations.json", payload)
    files = spark.createDataFrame([(bytearray(payload),), (bytearray(packed.getvalue()),), (bytearray(b"{oops"),)], "content binary")
    rows = parsers.tree_exports(files).collect()
    one = [(r.message_no, r.role, r.text, r.skipped) for r in rows if r.conversation_id == "c1"][:3]
    assert one == [(0, "system", "sys", []), (1, "user", "see this", ["execution_output", "image"]), (2, "assistant", "end", [])]
    assert sum(r.conversation_id == "c1" for r in rows) == 6 and sum(r.error is not None for r in rows) == 3
    assert parsers.sniff(payload) == "chatgpt" and parsers.sniff(b'{"conversations": []}') == "grok" and parsers.sniff(b'[{"chat_messages": []}]') == "claude" and parsers.sniff(b"x") is None


def test_vaults(spark, tmp_path):
    (tmp_path / "v/Projects").mkdir(parents=True)
    (tmp_path / "v/.obsidian").mkdir()
    (tmp_path / "v/Inbox.md").write_text("# In\n#tag")
    (tmp_path / "v/Projects/Acme.md").write_text("body")
    (tmp_path / "v/blank.md").write_text("  \n")
    (tmp_path / "v/bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "v/.obsidian/x.md").write_text("hidden")
    got = {r.path: (r.title, r.error is None) for r in parsers.vault_directory(spark, str(tmp_path / "v")).collect()}
    assert got == {"Inbox.md": ("In", True), "Projects/Acme.md": ("Acme", True), "bad.md": (None, False)}
    with zipfile.ZipFile(tmp_path / "v.zip", "w") as z:
        z.writestr("Inbox.md", "# In")
        z.writestr("a/.b/c.md", "hidden")
        z.writestr("pic.png", b"x")
    (tmp_path / "broken.zip").write_bytes(b"PK")
    zipped = {r.path.rsplit("/", 1)[-1]: r.error is None for r in parsers.vault_zips(spark, str(tmp_path / "*.zip")).collect()}
    assert zipped == {"Inbox.md": True, "broken.zip": False}


def test_plain_blocks(spark):
    df = spark.createDataFrame([(1, "One.\n\nTwo.\n\n \n\n"), (2, None), (3, "")], "k long, t string")
    assert [(r.k, r.block_no, r.block) for r in parsers.plain_blocks(df, "k", "t").collect()] == [(1, 0, "One."), (1, 1, "Two.")]


@pytest.mark.parametrize("path, base, out", [("./a/../b.md", "", "b.md"), ("../x", "d/e", "d/x"), ("/r/y", "d", "r/y"), ("..\\z", "q", "z")])
def test_paths(path, base, out):
    assert parsers.normal_path(path, base) == out


def test_vault_limits_times_and_dispatch(spark, tmp_path, monkeypatch):
    root = tmp_path / "w"
    (root / ".obsidian").mkdir(parents=True)
    (root / ".obsidian" / "x.md").write_text("hidden")
    (root / "a.md").write_text("# A")
    (root / "b.md").write_text("b" * 100)
    got = parsers.vault_directory(spark, str(root)).collect()
    assert {r.path for r in got} == {"a.md", "b.md"} and all(r.modified_us > 1_500_000_000_000_000 for r in got)
    monkeypatch.setattr(parsers, "MAX_BYTES", 50)
    assert [r.error for r in parsers.vault_directory(spark, str(root)).collect()] == ["vault exceeds the limits"]
    assert parsers.dispatch("x/Note.MD") == "markdown_file" and parsers.dispatch("t.txt") == "text_file" and parsers.dispatch("t.bin") is None
    assert parsers.dispatch("v", names=[".obsidian/app.json", "a.md"]) == "obsidian_vault" and parsers.dispatch("e.zip", names=["conversations.json"]) == "chatgpt_export"
    assert parsers.dispatch("e.json", b'[{"chat_messages": []}]') == "claude_export" and parsers.dispatch("e.json", b"oops") is None
