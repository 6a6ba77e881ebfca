import pytest
from pyspark.sql import functions as F

from cairn.operators.nested import NodeType, link, node_tables

SPEC = (
    NodeType("message", "messages", {"text": "text"}, (NodeType("part", "parts", {"kind": "kind"}, (NodeType("mark", "marks", {"m": "m"}),)), NodeType("file", "files", {"file": "name"}))),
    NodeType("tag", "tags", {"tag": "t"}),
)
SCHEMA = "id long, messages array<struct<text string, parts array<struct<kind string, marks array<struct<m int>>>>, files array<struct<name string>>>>, tags array<struct<t string>>, pre int"
ROWS = [
    (1, [("a", [("x", [(1,), (2,)]), None, ("y", None)], [("f",)]), None, ("b", None, []), ("c", [("z", [(3,)])], None)], [("t1",), ("t2",)], 5),
    (2, [], None, 5),
    (3, None, [None, ("t3",)], 5),
    (None, [("n", [("q", [])], None)], None, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    return node_tables(spark.createDataFrame(ROWS, SCHEMA), ["id"], SPEC)


def test_positions_count_nulls_and_name_ancestors(tables):
    assert sorted((r.id, r.position, r.text) for r in tables["message"].where("id = 1").collect()) == [(1, 0, "a"), (1, 2, "b"), (1, 3, "c")]
    assert sorted((r.message_index, r.position, r.kind) for r in tables["part"].where("id = 1").collect()) == [(0, 0, "x"), (0, 2, "y"), (3, 0, "z")]
    assert sorted((r.message_index, r.part_index, r.m) for r in tables["mark"].collect()) == [(0, 0, 1), (0, 0, 2), (3, 0, 3)]
    assert [r.tag for r in tables["tag"].where("id = 3").collect()] == ["t3"]
    assert tables["message"].where("id is null").count() == 1


def test_intervals_nest_and_siblings_do_not_overlap(tables):
    nodes = [(name, r.id, r.pre, r.post, r.parent_pre) for name, t in tables.items() for r in t.where("id is not null").select("id", "pre", "post", "parent_pre").collect()]
    by = {(i, pre): post for _, i, pre, post, _ in nodes}
    assert len(by) == len(nodes), "labels are unique within a record"
    for _, i, pre, post, parent in nodes:
        assert pre < post
        if parent is not None:
            assert parent < pre and post < by[(i, parent)]
    for _, i, pre, post, _ in nodes:
        for _, j, pre2, post2, _ in nodes:
            if i == j and pre < pre2:
                assert post2 < post or post < pre2


def test_containment_finds_the_parent(tables):
    linked = link(tables["mark"], tables["part"], "id", {"parent_kind": "kind", "found_pre": "pre"}).collect()
    assert {(r.m, r.parent_kind) for r in linked} == {(1, "x"), (2, "x"), (3, "z")}
    assert all(r.found_pre == r.parent_pre for r in linked)
    grand = link(tables["mark"], tables["message"], "id", {"t": "text"}).collect()
    assert {(r.m, r.t) for r in grand} == {(1, "a"), (2, "a"), (3, "c")}


def _walk(record):
    """The numbers that a depth-first walk gives, by node type and positions."""
    tick, out = 0, {}

    def visit(name, place, children):
        nonlocal tick
        pre, tick = tick, tick + 1
        for child, values, below in children:
            for i, value in enumerate(values or []):
                if value is not None:
                    visit(child, (*place, i), below(value))
        out[(name, place)] = (pre, tick)
        tick += 1

    marks = lambda p: [("mark", p[1], lambda m: [])]
    message = lambda m: [("part", m[1], marks), ("file", m[2], lambda f: [])]
    visit("record", (), [("message", record[1], message), ("tag", record[2], lambda t: [])])
    return out


def test_labels_are_those_of_a_depth_first_walk(spark, tables):
    deep = (7, [(f"m{i}", [(f"p{j}", [(k,) for k in range(j % 4)]) for j in range(i % 9)], [("f",)] * (i % 3)) for i in range(50)], [("t",), None], 5)
    for rows, found in ((ROWS, tables), ([deep], node_tables(spark.createDataFrame([deep], SCHEMA), ["id"], SPEC))):
        for record in rows:
            got = {}
            for name, t in found.items():
                for r in t.where(F.col("id").eqNullSafe(F.lit(record[0]))).collect():
                    place = () if name == "record" else (*(r[c] for c in t.columns if c.endswith("_index")), r.position)
                    got[(name, place)] = (r.pre, r.post)
            assert got == _walk(record)


def test_clashing_names_are_refused_and_empty_tables_work(spark):
    with pytest.raises(ValueError):
        node_tables(spark.createDataFrame(ROWS, SCHEMA), ["id"], (NodeType("m", "messages", {"pre": "text"}),))
    empty = node_tables(spark.createDataFrame([], SCHEMA), ["id"], SPEC)
    assert all(t.count() == 0 for t in empty.values())


def test_labelling_takes_no_shuffle(tables):
    plan = tables["mark"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert tables["part"].where(F.col("kind") == "x").count() == 1
