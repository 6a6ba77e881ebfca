import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import text, vectors
from cairn.operators import enrich, graph, imports, retrieval
from cairn.sources.store import ObjectStore, Snapshots, copy_table


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(column).first()[0]


@pytest.mark.parametrize("a, b, score", [("", "x", 0.0), ("Running shoes", "running shoe", 1.0), ("red apples", "I ate red apples today", 1.0), ("one two three", "two three four", 2 / 3), (None, "x", 0.0)])
def test_overlap(spark, a, b, score):
    assert one(spark, text.overlap_score(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(score)


@pytest.mark.parametrize("word, out", [("queries", "query"), ("class", "class"), ("dogs", "dog" if len("dogs") > 4 else "dogs"), ("houses", "house"), ("ties", "ties")])
def test_singular(spark, word, out):
    assert one(spark, text.singular(F.col("a")), a=word) == out


def test_normal_forms(spark):
    assert one(spark, text.key_text(F.col("a")), a="  Héllo, WORLD-2 ") == "h llo world 2"
    assert one(spark, text.entity_type(F.col("a")), a="Company") == "organization"
    assert one(spark, text.entity_type(F.col("a")), a="Odd Type!") == "odd_type"
    assert one(spark, text.entity_type(F.col("a")), a=None) == "entity"
    for name, kind, keep in (("Claude Assistant", "person", False), ("Claude Assistant", "tool", True), ("src/x", "file", False), ("Settings", "concept", False), ("Queue", "x", False), ("Ada", "person", True), (None, None, False)):
        assert one(spark, text.is_entity(F.col("a"), F.col("b")), a=name, b=kind) == keep
    assert one(spark, text.tag(F.col("a")), a="##Work//Sub /") == "work/sub"
    assert one(spark, text.inline_tags(F.col("a")), a="(#A/b) x#no #c #C") == ["a/b", "c"]
    assert one(spark, text.shorten(F.col("a"), 3), a="abcd") == "abc..."
    assert text.like_literal("50%_\\") == "50\\%\\_\\\\"


@pytest.mark.parametrize("query, operator", [("plain words", False), ('"a phrase"', True), ('"unbalanced', False), ("(a OR b)", True), ("a) (b", False), ("x -y", True), ("pre*", True), ("ANDy", False), ("a AND b", True)])
def test_query_modes(query, operator):
    assert retrieval.is_operator_query(query) == operator


def test_matches(spark):
    df = spark.createDataFrame([("horse training, daily",), ("Training a horse",), ("dressage",), (None,), ("",)], "t string")
    pick = lambda q: [r[0] for r in df.where(retrieval.matches(F.col("t"), q)).collect()]
    assert pick('"horse training"') == ["horse training, daily"]
    assert pick("horse AND NOT daily") == ["Training a horse"]
    assert pick("dress* OR daily") == ["horse training, daily", "dressage"]
    assert pick("(dress* OR horse) -daily") == ["Training a horse", "dressage"]


def test_bm25_ranks_better_matches_first(spark):
    df = spark.createDataFrame([("high", "dressage horse training"), ("medium", "a horse and some training among other words here"), ("low", "one horse among very many other words which say nothing at all"), ("none", "x"), ("null", None)], "k string, t string")
    scores = {r.k: r.score for r in retrieval.bm25(df, "k", F.col("t"), ["dressage", "horse", "training"]).collect()}
    assert set(scores) == {"high", "medium", "low"} and scores["high"] > scores["medium"] > scores["low"]
    assert retrieval.bm25(df.limit(0), "k", F.col("t"), ["x"]).count() == 0


def test_candidates_of_all_kinds(spark):
    art = spark.createDataFrame([("a", "On Rust", "notes/x.md"), ("b", None, "notes/rust.md"), ("c", "Other", None)], "artifact_id string, title string, path_key string")
    tags = spark.createDataFrame([("a", "rust", 0), ("b", "rusty", 0)], "artifact_id string, tag string, seq int")
    aliases = spark.createDataFrame([("c", "rust", "Rust"), ("b", "rust book", "Rust Book")], "artifact_id string, alias string, alias_text string")
    links = spark.createDataFrame([("c", 0, "Rust", None, "Rust"), ("c", 1, "https://rust.org", "rust site", "https://rust.org"), ("c", 2, "https://x.org", "Rust", "https://x.org"), ("c", 3, "https://x.org", None, "rust:x"), ("c", 4, None, None, None)], "artifact_id string, seq int, external_url string, display_text string, raw_target string")
    objects = spark.createDataFrame([("a", "o1", "Rust", "about rust"), ("a", "o2", None, "RUST"), ("a", "o3", None, None)], "artifact_id string, derived_object_id string, title string, body_text string")
    segments = spark.createDataFrame([("s1", "a", "some rust"), ("s2", "a", None)], "segment_id string, artifact_id string, text_content string")
    got = {(r.match_kind, r.match_record_id): (r.snippet, r.score_hint, r.matched_fields) for r in retrieval.candidates(art, tags, aliases, links, objects, segments, ["Rust", "nothing"]).collect()}
    assert got == {
        ("artifact_title", "a"): ("On Rust", 240, ["title"]),
        ("imported_note_tag", "a#0"): ("rust", 380, ["tag"]),
        ("imported_note_alias", "c#rust"): ("Rust", 370, ["alias"]),
        ("imported_note_path", "b"): ("notes/rust.md", 220, ["path"]),
        ("imported_external_link", "c#0"): ("Rust", 395, ["external_url", "raw_target"]),
        ("imported_external_link", "c#1"): ("rust site", 390, ["external_url", "display_text", "raw_target"]),
        ("imported_external_link", "c#2"): ("Rust", 250, ["display_text"]),
        ("imported_external_link", "c#3"): ("https://x.org", 230, ["raw_target"]),
        ("derived_object", "o1"): ("Rust", 360, ["title", "body_text"]),
        ("derived_object", "o2"): ("RUST", 360, ["body_text"]),
        ("segment_excerpt", "s1"): ("some rust", 300, ["text_content"]),
    }


def test_blend(spark):
    lx = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, score double")
    sm = spark.createDataFrame([("b", 0.5), ("c", 1.7)], "k string, score double")
    assert {r.k: round(r.score, 6) for r in retrieval.blend(lx, sm, "k").collect()} == {"a": 0.2, "b": 0.6, "c": 1.0}


def test_knn_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype("float32")
    x[7] = x[3]  # a tie
    x[9] = 0
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(300, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in retrieval.batch_knn(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding", 4, "label").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    n = x.astype("float64") / np.maximum(np.linalg.norm(x.astype("float64"), axis=1, keepdims=True), 1e-300)
    for q in range(0, 300, 50):
        s = np.round(np.maximum(n @ n[q], 0), 9)
        order = sorted((i for i in range(300) if i != q and i % 3 == q % 3), key=lambda i: (-s[i], i))[:4]
        assert [got[q][k] for k in (1, 2, 3, 4)] == order
    assert vectors.stub_embedding("abc", 4) == pytest.approx(vectors.stub_embedding("abc", 4)) and sum(v * v for v in vectors.stub_embedding("abc", 4)) == pytest.approx(1)


def test_hot_key_neighbours(spark):
    objects = spark.range(5000).select(F.concat(F.lit("d-"), "id").alias("oid"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("k"), "id")).alias("key"))
    starts = spark.createDataFrame([("d-0",), ("d-1",), ("d-3",), ("none",)], "node string")
    found = graph.shared_key(starts, objects, "key", "oid", 20)
    assert {r.node: r["count"] for r in found.groupBy("node").count().collect()} == {"d-0": 20}
    hot = sorted(f"d-{i}" for i in range(2, 5000, 2))
    assert sorted(r.neighbour for r in found.collect()) == hot[:20]
    assert graph.shared_key(starts, objects, "key", "oid", 10_000).count() == 2499


def test_stars(spark):
    df = spark.createDataFrame([("a", "t"), ("b", "t"), ("a", "t"), ("c", "u"), ("d", ""), ("e", None)], "m string, v string")
    assert sorted(tuple(r) for r in graph.groups_by_value(df, "m", "v").collect()) == [("t", "a", "a", 2), ("t", "a", "b", 2)]


def test_chunks():
    assert enrich.chunk_bounds([4, 4, 4], 2, 10, 1) == [(0, 2), (1, 3)]
    assert enrich.chunk_bounds([20, 1, 1], 5, 10, 2) == [(0, 1), (1, 3)]
    assert enrich.chunk_bounds([], 2, 10, 1) == [] and enrich.chunk_bounds([1, 1], 5, 10, 1) == [(0, 2)]
    for sizes, most, room, lap in (([3] * 50, 7, 15, 3), ([1, 99, 1, 1], 1, 5, 9)):
        out = enrich.chunk_bounds(sizes, most, room, lap)
        assert out[0][0] == 0 and out[-1][1] == len(sizes) and all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(out, out[1:]))


def test_chunks_of_long_artifacts_are_those_of_one_scan(spark):
    import random

    rng = random.Random(5)
    rows = [(a, n // 2 if a == "twice" else n * step, f"{n:06d}", None if n % 97 == 0 else "x" * rng.choice([0, 30, 400, 400, 900, 13_000 if n % 50 == 0 else 5])) for a, size, step in (("long", 12_000, 1), ("sparse", 11_000, 701), ("twice", 10_003, 1), ("edge", 5_000, 1), ("over", 5_001, 1), ("tiny", 3, 1), (None, 7_000, 1)) for n in range(size)]
    df = spark.createDataFrame(rows, "artifact_id string, sequence_no int, segment_id string, text_content string").repartition(7)
    got: dict = {}
    for r in enrich.chunks(df).collect():
        got.setdefault(r.artifact_id, []).append((r.chunk_no, r.first_no, r.last_no, r.n_items, r.n_bytes))
    held: dict = {}
    for a, no, _, t in rows:
        held.setdefault(a, []).append((no, len(t or "")))
    assert got.keys() == held.keys()
    for a, items in held.items():
        sizes = [size for _, size in items]
        want = [(k, items[s][0], items[e - 1][0], e - s, sum(sizes[s:e])) for k, (s, e) in enumerate(enrich.chunk_bounds(sizes, 40, 12_000, 2))]
        assert sorted(got[a]) == want, a


def test_cluster_and_upserts(spark):
    df = spark.createDataFrame([("x", "1", "the user rides horses daily"), ("x", "2", "user rides horses"), ("x", "3", "other thing"), ("x", "4", "other thing"), ("y", "5", ""), ("y", "6", None)], "g string, k string, t string")
    assert {r.k: r.leader for r in enrich.cluster(df, "g", "k", F.coalesce("t", F.lit(""))).collect()} == {"1": "1", "2": "1", "3": "3", "4": "3", "5": "5", "6": "5"}
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 6), (3, "c", 7)], "k int, v string, n int")
    assert sorted(map(tuple, enrich.upsert_coalesce(old, new, ["k"]).collect())) == [(1, "a", None), (2, "b", 6), (3, "c", 7)]
    assert sorted(map(tuple, enrich.upsert_ignore(old, new.union(new), ["k"]).collect())) == [(1, "a", None), (2, "b", 5), (3, "c", 7)]


def test_import_plan(spark):
    old = spark.createDataFrame([("e1", "s", "v1", "h1")], "artifact_id string, source_type string, hash_version string, content_hash string")
    new = spark.createDataFrame([("n1", "s", "v1", "h1"), ("n2", "s", "v1", "h2"), ("n3", "s", "v1", "h2"), ("n4", "s", "v1", None)], old.schema)
    planned = imports.plan_import(old, new).cache()
    assert {r.artifact_id: (r.final_id, r.outcome) for r in planned.collect()} == {"n1": ("e1", "already_exists"), "n2": ("n2", "imported"), "n3": ("n2", "already_exists"), "n4": (None, "failed")}
    assert {r.outcome: r.n for r in imports.summary(planned).collect()} == {"already_exists": 2, "imported": 1, "failed": 1}
    segments = spark.createDataFrame([("s1", "n1"), ("s2", "n2")], "segment_id string, artifact_id string")
    assert [r.segment_id for r in imports.remap(segments, planned).collect()] == ["s2"]
    assert imports.plan_import(old.limit(0), new.limit(0)).count() == 0


def test_store(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path / "objects"))
    rows = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"a"),), (None,)], "body binary")
    assert sorted(r.was_created for r in store.put(rows, "body").collect()) == [True, True]
    again = store.put(spark.createDataFrame([(bytearray(b"b"),), (bytearray(b"c"),)], "body binary"), "body").collect()
    assert sorted(r.was_created for r in again) == [False, True]
    assert sorted(bytes(r.content) for r in store.get(spark.createDataFrame([(r.sha256,) for r in again], "sha256 string")).collect()) == [b"b", b"c"]
    table = Snapshots(spark, str(tmp_path / "t"))
    assert table.current() is None
    table.write(spark.range(3).toDF("id"))
    reader = table.read()
    table.write(table.read().where("id > 0"))
    assert table.read().count() == 2 and reader.count() == 3
    copy_table(table.read(), path=str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 2


def test_related_links_first_then_keys(spark):
    objects = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", "k"), ("d", None), ("e", "")], "oid string, key string")
    edges = spark.createDataFrame([("a", "c", "e2"), ("d", "a", "e1"), ("c", "a", "e0")], "source string, target string, edge_id string")
    starts = objects.select(F.col("oid").alias("node"))
    got = {}
    for r in graph.related(starts, edges, objects, "key", "oid", 2).orderBy("node", "place").collect():
        got.setdefault(r.node, []).append((r.neighbour, r.relation))
    assert got == {"a": [("c", "link"), ("d", "link")], "b": [("a", "shared_key"), ("c", "shared_key")], "c": [("a", "link"), ("b", "shared_key")], "d": [("a", "link")]}


def test_knn_blocks_equal_one(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 6).astype("float32").tolist(), i % 2 or None) for i in range(200)] + [(900, None, 1), (901, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    queries = df.where("vec_id % 5 = 0")
    one = sorted(map(tuple, retrieval.batch_knn(df, queries, "vec_id", "embedding", 5, "label").collect()))
    many = sorted(map(tuple, retrieval.batch_knn(df, queries, "vec_id", "embedding", 5, "label", block_bytes=1000).collect()))
    assert len(one) == 5 * 40 and one == many


def test_ranks_of_skewed_groups(spark):
    from cairn.operators import ranks

    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in np.round(rng.exponential(10, 30_000), 2)] + [("few", 2.0), ("few", 1.0), ("nan", float("nan")), ("nan", 3.0), (None, 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = lambda p: (p, lambda n: F.floor((n - 1) * p))
    got = {r.g: (r.n, r.p0, r.p50, r.p99) for r in ranks.values_at(df, "g", "v", {"p0": at(0.0), "p50": at(0.5), "p99": at(0.99)}).collect()}
    hot = sorted(v for g, v in rows if g == "hot")
    assert got["hot"] == (30_000, hot[0], hot[int(29_999 * 0.5)], hot[int(29_999 * 0.99)])
    assert got["few"] == (2, 1.0, 1.0, 1.0) and got["nan"][:3] == (2, 3.0, 3.0) and got[None] == (1, 4.0, 4.0, 4.0) and "none" not in got


def test_near_and_cover(spark):
    df = spark.createDataFrame([(1, "red x y blue"), (2, "blue red"), (3, "red a b c d e f blue"), (4, "red"), (5, None)], "i int, t string")
    near = {r.i for r in df.where(retrieval.matches(F.col("t"), "red NEAR/2 blue")).collect()}
    assert near == {1, 2} and retrieval.is_operator_query("red NEAR/2 blue")
    rank = {r.i: r.r for r in df.select("i", retrieval.cover_all({"D": F.col("t")}, ["red", "blue"]).alias("r")).collect()}
    assert rank[2] == pytest.approx(0.1) and rank[1] == pytest.approx(0.1 / 3) and rank[3] == pytest.approx(0.1 / 7) and rank[4] == 0 and not rank[5]


def test_folding_and_targets(spark):
    from cairn.functions import text
    from cairn.sources import parsers

    got = spark.range(1).select(text.folded(F.lit("Caf\u00c9 \u00fcber \u0141\u00f3d\u017a")).alias("t")).first().t
    assert got == "cafe uber \u0142odz"
    assert parsers._class_of("a/b.avif") == parsers._class_of("x.txt") == "attachment" and parsers._class_of("x.tiff") == parsers._class_of(".txt") == "note"
    assert parsers.vault_target("obsidian://open?vault=v&file=a%2Fb") == "a/b.md" and parsers.vault_target("https://a.b/c") is None
    assert parsers._class_of("obsidian://open?vault=v&file=a%2Fb%23H") == "heading" and parsers._class_of("file:///x/y.png") == "attachment"
    assert parsers.ensure_note("a/b#h") == "a/b.md#h" and parsers.ensure_note("a.md") == "a.md" and parsers.stem("x\\y/Note.MD") == "note"


def _greedy(rows, threshold=0.9):
    leaders, out = [], []
    for ident, t in rows:
        words = set((t or "").split())
        found = next((lead for lead, other, ws in leaders if t and other and (t in other or other in t or (words and ws and len(words & ws) / min(len(words), len(ws)) >= threshold))), None)
        if found is None:
            leaders.append((ident, t or "", words))
        out.append((ident, found or ident))
    return out


def test_clusters_equal_a_full_comparison(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 14))) for _ in range(250)]
    texts += [t[2:-1] for t in texts[:60]] + [t + " w1 w2" for t in texts[:40]] + ["", None, "w", "1 w"]
    distinct = list(dict.fromkeys(texts))
    rows = [("a", f"{i:04d}", t) for i, t in enumerate(distinct)] + [("b", "x1", "w1 w2"), ("b", "x2", "w2 w1"), (None, "n", "w1")]
    df = spark.createDataFrame(rows, "g string, k string, t string")
    got = {(r.g, r.k): r.leader for r in enrich.cluster(df, "g", "k", F.col("t")).collect()}
    assert {k: v for (g, k), v in got.items() if g == "a"} == dict(_greedy([(f"{i:04d}", t) for i, t in enumerate(distinct)]))
    assert got[("b", "x2")] == "x1" and got[(None, "n")] == "n" and len(got) == len(rows)


def test_merges_statuses_and_writes(spark):
    df = spark.createDataFrame([("k", "s1", "long one", 3, "b"), ("k", "s0", "same len", 9, "a"), ("k", "s2", None, None, " b "), ("n", "s3", None, None, None)], "key string, id string, t string, i int, s string")
    got = {r.key: r for r in enrich.merge_outputs(df, ["key"], ["t"], "i", "s", "id").collect()}
    assert (got["k"].t, got["k"].i, got["k"].s, got["k"].n_merged) == ("same len", 9, "a b", 3) and got["n"].s is None and got["n"].t is None
    objects = spark.createDataFrame([("o1", "active"), ("o2", "superseded")], "derived_object_id string, object_status string")
    asked = spark.createDataFrame([("o1", "superseded", "o9"), ("o2", "rejected", None), ("o3", "rejected", None)], "derived_object_id string, to_status string, replacement string")
    told = {r.derived_object_id: (r.object_status, r.replacement, r.outcome) for r in enrich.change_status(objects, asked).collect()}
    assert told == {"o1": ("superseded", "o9", "changed"), "o2": ("superseded", None, "not_active"), "o3": (None, None, "not_found")}
    rows = spark.createDataFrame([(1, "a", 1, None), (1, "a", 2, None), (1, "b", 3, "bad"), (2, "c", 4, "bad"), (3, "a", 5, None)], "batch int, key string, n long, error string")
    out = {r.batch: (r.n_created, r.n_existing, r.n_failed, r.status) for r in imports.write_outcomes(rows, "batch", "key", "n").collect()}
    assert out == {1: (1, 1, 1, "completed_with_errors"), 2: (0, 0, 1, "failed"), 3: (0, 1, 0, "completed")}


def test_vector_store(spark):
    from cairn.operators import vectorstore

    old = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b")], "id long, v array<float>, p string")
    new = spark.createDataFrame([(2, [1.0, 1.0], "c"), (2, [1.0, 0.5], "c"), (3, [-1.0, 0.0], "d"), (None, [0.0, 0.0], "e")], "id long, v array<float>, p string")
    points = vectorstore.upsert(old, new, "id", "v")
    assert {(r.id, r.p) for r in points.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert vectorstore.upsert(old.limit(0), new, "id", "v").count() == 2
    with pytest.raises(Exception, match="2 dimensions"):
        vectorstore.upsert(old, spark.createDataFrame([(4, [1.0], "x")], "id long, v array<float>, p string"), "id", "v").collect()
    hits = vectorstore.search(points, "id", "v", [1.0, 0.0], 5, must=[F.col("p").isNotNull()], must_not=[F.col("p") == "d"])
    assert [(r.place, r.id) for r in hits.collect()] == [(1, 1), (2, 2)]
    rows = spark.createDataFrame([(2, "row")], "id long, t string")
    assert [(r.place, r.id, r.t) for r in vectorstore.hydrate(hits, rows, "id", 5).collect()] == [(1, 2, "row")]


def test_payload_functions(spark):
    from cairn.functions import payload

    one_of = lambda column: spark.range(1).select(column.alias("x")).first().x
    for text_, found in (('x\n```json\n{"a": 1}\n```\ny', '{"a": 1}'), (' [1, 2] ', "[1, 2]"), ('so {"a": {"b": 2}} it is', '{"a": {"b": 2}}'), ("no json {", None), (None, None)):
        assert one_of(payload.salvaged(F.lit(text_).cast("string"))) == found
    used = one_of(payload.usage(F.lit('{"promptTokenCount": 3, "thoughtsTokenCount": 1}')))
    assert (used.input_tokens, used.output_tokens, used.reasoning_tokens, used.total_tokens) == (3, None, 1, 3)
    assert one_of(payload.usage(F.lit(None).cast("string"))).total_tokens is None
    now = F.lit(1_700_000_000_000_000)
    for value, seconds in (("30", 30), ("12.5s", 13), ("Tue, 14 Nov 2023 22:13:25 GMT", 5), ("Tue, 14 Nov 2022 22:13:25 GMT", 0), ("soon", None)):
        assert one_of(payload.retry_after(F.lit(value), now)) == (0 if value.endswith("2022 22:13:25 GMT") else seconds)
    assert one_of(payload.string_list(F.lit('["a", "b"]'))) == ["a", "b"] and one_of(payload.string_list(F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="not a JSON array"):
        one_of(payload.string_list(F.lit("{oops")))


def test_late_rows_and_idle_state(spark, tmp_path):
    import pandas as pd

    from cairn.streaming import events

    def write(name, rows):
        frame = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        frame["ts"] = pd.to_datetime(frame["ts"]).astype("datetime64[us]")
        frame.to_parquet(tmp_path / name)

    write("e1.parquet", [(1, "2024-01-01 10:00", 1, "view", 1.0, ""), (2, "2024-01-01 12:00", 1, "click", 1.0, ""), (3, "2024-01-01 10:03", 2, "view", 2.0, "")])
    write("e2.parquet", [(6, "2024-01-01 12:01", 3, "view", 1.0, "")])
    write("e3.parquet", [(4, "2024-01-01 10:05", 1, "view", 5.0, ""), (5, "2024-01-01 16:00", 1, "view", 1.0, ""), (5, "2024-01-01 16:00", 1, "view", 1.0, "")])
    import os

    for i in (1, 2, 3):
        os.utime(tmp_path / f"e{i}.parquet", (i, i))
    stream = lambda: events.read(spark, str(tmp_path), files="e*.parquet", per_trigger=1)
    got = {(r.start_us // 3_600_000_000 % 24, r.event_type): (r.n, r.total) for r in events.drain(events.tumbling(stream()), "append", "late").collect()}
    assert got == {(10, "view"): (2, 3.0), (12, "click"): (1, 1.0), (12, "view"): (1, 1.0)}, "the row that came after the watermark had passed is left out"
    sessions = sorted((r.user_id, r.n) for r in events.drain(events.sessions(stream()), "append", "late-session").collect())
    assert sessions == [(1, 1), (1, 1), (2, 1), (3, 1)]
    states = events.drain(events.job_states(stream()), "update", "late-jobs").where("user_id = 1").orderBy(F.desc("last_id")).first()
    assert (states.status, states.attempts, states.last_id) == ("running", 2, 5)


def test_stored_index(spark, tmp_path):
    from cairn.operators import lexical

    df = spark.createDataFrame([(1, "Caf\u00e9 con leche, caf\u00e9"), (2, "cafe solo"), (3, "te"), (4, None), (None, "cafe")], "id long, t string")
    where = f"file://{tmp_path}/index"
    lexical.build(df, "id", F.col("t"), where, 2)
    got = {r.id: r.score for r in lexical.ranked(spark, where, "id", "caf\u00c9!").collect()}
    assert set(got) == {1, 2} and got[1] > got[2] > 0
    plan = lexical.ranked(spark, where, "id", "solo te")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "In(term, [" in plan
    lexical.build(df.where("id = 3"), "id", F.col("t"), where)
    assert [r.id for r in lexical.ranked(spark, where, "id", "te cafe").collect()] == [3]
    assert lexical.ranked(spark, where, "id", "...").count() == 0
    with pytest.raises(FileNotFoundError):
        lexical.ranked(spark, where + "-none", "id", "te")


def test_store_deletes_and_pointers(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path / "objects"))
    put = store.put(spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"c"),)], "content binary"), "content").collect()
    first = sorted(r.sha256 for r in put)[0]
    told = store.delete(spark.createDataFrame([(first,), ("00" * 32,), (None,)], "sha256 string"))
    assert {(r.sha256, r.was_deleted) for r in told.collect()} == {(first, True), ("00" * 32, False)}
    rest = store.get(spark.createDataFrame([(r.sha256,) for r in put], "sha256 string")).collect()
    assert {r.sha256 for r in rest} == {r.sha256 for r in put} - {first}
    table = Snapshots(spark, str(tmp_path / "snap"))
    assert table.current() is None
    for n in (1, 2, 3):
        table.write(spark.range(n))
    assert table.read().count() == 3
    copy_table(spark.range(100).orderBy(F.rand(1)), path=str(tmp_path / "sorted"), partitions=2, order=["id"])
    assert [r.id for r in spark.read.parquet(str(tmp_path / "sorted")).where("id < 3").collect()] == [0, 1, 2]


def test_clustered_vectors(spark):
    rows = vectors.clustered(spark, 40, 24, 4).collect()
    x = {r.vec_id: np.array(r.embedding) for r in rows}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-5 for v in x.values())
    assert min(x[i] @ x[i + 4] for i in range(36)) > 0.99 > max(x[i] @ x[i + 1] for i in range(39))
    assert [r.embedding for r in vectors.clustered(spark, 40, 24, 4).collect()] == [r.embedding for r in rows]
