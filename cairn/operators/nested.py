"""Deeply nested records to flat node tables linked by interval labels.

Every object of a record is a node of a tree.  A depth-first walk numbers the moments at which it
enters and leaves a node, from 0 at the record: ``pre`` and ``post``.  A node's interval ``[pre, post]``
contains exactly those of its descendants, and a node with ``n`` descendants spans ``2 n + 2`` numbers.
Children are visited type by type in the order of the specification, each array in its own order.

The walk needs no stack: a node's entry is its parent's plus the spans of what comes before it among
the siblings, a running sum over one array.  So labelling is a projection of the row, level by level:
no shuffle, no window and no Python.  Running sums are taken in chunks of the square root of the array's
length, so a node of n children costs n to the power 1.5 at most, and arrays of any length end.

Each node table has the record's key columns, ``pre``, ``post``, ``parent_pre``, ``position`` (the
place among its siblings, from 0, null elements counted), the positions of its ancestors, and the
node's own scalar fields.

Defined results: a null or empty array has no nodes; a null element keeps its position but yields no
node; a null struct inside a node gives null fields; records with a null key are kept; an empty
table gives empty node tables.  Column names of the payload are prefixed with nothing, so ``NodeType``
fields choose output names that do not clash with the label columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LABELS = {"pre", "post", "parent_pre", "position"}


@dataclass(frozen=True)
class NodeType:
    """One kind of node: where its array sits in the parent, and what to keep of it.

    ``path`` is a dotted path from the parent object to the array; ``fields`` maps output names to
    dotted paths inside the element.
    """

    name: str
    path: str
    fields: dict[str, str] = field(default_factory=dict)
    children: tuple[NodeType, ...] = ()


def _get(base: Column, path: str) -> Column:
    for part in path.split("."):
        base = base.getField(part)
    return base


def _span(node: NodeType, element: Column) -> Column:
    """Numbers that a node and its descendants take; a null element takes none."""
    inside = sum((_spans(child, _get(element, child.path)) for child in node.children), F.lit(2).cast("long"))
    return F.when(element.isNull(), F.lit(0).cast("long")).otherwise(inside)


def _spans(node: NodeType, array: Column) -> Column:
    """Numbers that all elements of an array take."""
    if not node.children:
        return 2 * F.greatest(F.coalesce(F.size(F.filter(array, lambda o: o.isNotNull())), F.lit(0)), F.lit(0)).cast("long")
    return F.coalesce(F.aggregate(F.transform(array, lambda o: _span(node, o)), F.lit(0).cast("long"), lambda total, x: total + x), F.lit(0).cast("long"))


def _each(node: NodeType, array: Column) -> Column:
    return F.transform(array, lambda o: _span(node, o))


def _running(sizes: Column) -> Column:
    """Sums of what comes before each element of an array of longs."""
    chunk = F.greatest(F.ceil(F.sqrt(F.size(sizes))), F.lit(1)).cast("int")
    last = F.greatest(F.floor((F.size(sizes) - 1) / chunk), F.lit(0)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(sizes, j * chunk + 1, chunk))
    state = lambda run, out: F.struct(run.alias("run"), out.alias("out"))
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")

    def along(run: Column, part: Column) -> Column:
        return F.aggregate(part, state(run, none), lambda acc, x: state(acc["run"] + x, F.concat(acc["out"], F.array(acc["run"]))))

    def over(acc: Column, part: Column) -> Column:
        done = along(acc["run"], part)
        return state(done["run"], F.concat(acc["out"], done["out"]))

    return F.aggregate(chunks, state(zero, none), over, lambda acc: acc["out"])


def _descend(df: DataFrame, keys: list[str], nodes: tuple[NodeType, ...], ancestors: list[str], out: dict[str, DataFrame]) -> None:
    start = F.col("_pre") + 1
    for node in nodes:
        array = F.col(node.path) if not ancestors else _get(F.col("_o"), node.path)
        carried = [*keys, *ancestors]
        spans = _each(node, array)
        zipped = F.arrays_zip(F.transform(array, lambda o: o), _running(spans), spans)
        exploded = df.select(*carried, F.col("_pre").alias("_up"), start.alias("_at"), F.posexplode(zipped).alias("_p", "_z"))
        own = exploded.select(*carried, "_up", "_p", (F.col("_at") + F.col("_z")["1"]).alias("_pre"), F.col("_z")["2"].alias("_span"), F.col("_z")["0"].alias("_o")).where(F.col("_o").isNotNull())
        out[node.name] = own.select(
            *carried,
            F.col("_pre").alias("pre"),
            (F.col("_pre") + F.col("_span") - 1).alias("post"),
            F.col("_up").alias("parent_pre"),
            F.col("_p").alias("position"),
            *(_get(F.col("_o"), path).alias(name) for name, path in node.fields.items()),
        )
        if node.children:
            below = own.select(*carried, F.col("_p").alias(f"{node.name}_index"), "_pre", "_o")
            _descend(below, keys, node.children, [*ancestors, f"{node.name}_index"], out)
        start = start + _spans(node, array)  # the next type of sibling comes behind


def node_tables(df: DataFrame, keys: list[str], nodes: tuple[NodeType, ...], root: str = "record", fields: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Flat tables of every node type of ``df``, by name; ``root`` is the record itself."""
    everything = [root]

    def names(level: tuple[NodeType, ...]) -> None:
        for n in level:
            if _LABELS & set(n.fields) or n.name in everything:
                raise ValueError(f"node type {n.name}: its name or a field name clashes")
            everything.append(n.name)
            names(n.children)

    names(nodes)
    room = sum((_spans(node, F.col(node.path)) for node in nodes), F.lit(0).cast("long"))
    labelled = df.withColumn("_pre", F.lit(0).cast("long"))
    out = {
        root: df.select(
            *keys,
            F.lit(0).cast("long").alias("pre"),
            (room + 1).alias("post"),
            F.lit(None).cast("long").alias("parent_pre"),
            F.lit(0).alias("position"),
            *(F.col(path).alias(name) for name, path in (fields or {}).items()),
        )
    }
    _descend(labelled, keys, nodes, [], out)
    return out


def link(children: DataFrame, parents: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Attach parent columns to children by interval containment.

    The parent of a node is the latest node of the parent type, in pre-order, whose interval is
    still open.  As siblings do not overlap, that is the last parent seen in a scan by ``pre``: one
    sort per record, no pairwise comparison.  Children outside every parent get nulls.
    """
    from pyspark.sql import Window

    mark = F.struct(F.col("post").alias("_post"), *(F.col(c).alias(n) for n, c in columns.items()))
    tagged = parents.select(key, "pre", mark.alias("_parent"), F.lit(None).alias("_child"))
    nodes = children.select(key, "pre", F.lit(None).alias("_parent"), F.struct(*children.columns).alias("_child"))
    both = tagged.unionByName(nodes)
    scan = Window.partitionBy(key).orderBy(F.col("pre"), F.col("_child").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_open", F.last("_parent", ignorenulls=True).over(scan)).where(F.col("_child").isNotNull())
    inside = F.col("_open._post") >= F.col("_child.post")
    return found.select("_child.*", *(F.when(inside, F.col(f"_open.{n}")).alias(n) for n in columns))
