"""Chunking, merging and clustering of derived records."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.durable import Workspace


def chunk_bounds(sizes: list[int], max_items: int, max_bytes: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy overlapping chunks ``[start, end)`` over item sizes, each with one item at least."""
    most = max(1, max_items)
    if len(sizes) <= most and sum(sizes) <= max_bytes:
        return [(0, len(sizes))] if sizes else []
    shared = min(overlap, most - 1)
    out, start = [], 0
    while start < len(sizes):
        end, held = start + 1, sizes[start]
        while end < len(sizes) and end - start < most and held + sizes[end] <= max_bytes:
            held += sizes[end]
            end += 1
        out.append((start, end))
        if end == len(sizes):
            break
        start = max(start + 1, end - shared)
    return out


#: Consecutive segments of an artifact that one task scans; it decides who works, not what comes out.
LANE = 5_000


def _chunk_ends(sizes: np.ndarray, most: int, max_bytes: int) -> np.ndarray:
    """For every start the end of the chunk that would begin there."""
    held = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = np.arange(len(sizes))
    fits = np.searchsorted(held, held[:-1] + max_bytes, side="right") - 1
    return np.minimum(np.clip(fits, at + 1, at + most), len(sizes))


def chunks(segments: DataFrame, max_items: int = 40, max_bytes: int = 12_000, overlap: int = 2) -> DataFrame:
    """``(artifact_id, chunk_no, first_no, last_no, n_items, n_bytes)`` of ordered segments.

    The next start depends on the last end, but an end only on the ``max_items`` sizes from its start
    on.  So long artifacts are cut into lanes of :data:`LANE` positions, each with the few rows after
    it.  A lane says for each of its first ``max_items`` positions where a scan entering there leaves
    into the next lane and after how many chunks; the entries that are taken are followed over those
    few rows per lane, and every lane lists its chunks from its entry.  The chunks are those of one
    scan over the whole artifact.  Null texts count 0 bytes.
    """
    most = max(1, max_items)
    shared, lane_rows = min(overlap, most - 1), max(LANE, most)
    sized = segments.where("sequence_no is not null").select("artifact_id", "sequence_no", "segment_id", F.coalesce(F.octet_length("text_content"), F.lit(0)).alias("size"), F.floor(F.col("sequence_no") / LANE).alias("run"))
    # Positions: within a run of sequence numbers, plus the rows of the runs before.
    within = F.row_number().over(Window.partitionBy("artifact_id", "run").orderBy("sequence_no", "segment_id")) - 1
    work = Workspace(segments.sparkSession, "chunks")
    row = work.cut(sized.select("artifact_id", "sequence_no", "size", "run", within.cast("long").alias("at")), "rows")
    ordered = Window.partitionBy("artifact_id").orderBy("run")
    runs = row.groupBy("artifact_id", "run").agg(F.count("*").alias("rows"))
    runs = runs.select(F.col("artifact_id").alias("_a"), F.col("run").alias("_run"), (F.sum("rows").over(ordered) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy("artifact_id")).alias("n"))
    pos = F.col("before") + F.col("at")
    placed = row.join(runs, F.col("artifact_id").eqNullSafe(F.col("_a")) & (F.col("run") == F.col("_run"))).select("artifact_id", "sequence_no", "size", pos.alias("pos"), "n", F.floor(pos / lane_rows).alias("own"))
    first = F.when((F.col("own") > 0) & (F.col("pos") % lane_rows < most - 1), F.col("own") - 1).otherwise(F.col("own"))
    lanes = placed.select("artifact_id", "sequence_no", "size", "pos", "n", F.explode(F.sequence(first, "own")).alias("lane"))

    def scan(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int, int]:
        """A lane's rows in order, their chunk ends, its own rows and the positions to the artifact's end."""
        group = group.sort_values("pos")
        left = int(group["n"].iloc[0]) - int(group["lane"].iloc[0]) * lane_rows
        return group, _chunk_ends(group["size"].to_numpy(), most, max_bytes), min(lane_rows, left), left

    def leave(group: pd.DataFrame) -> pd.DataFrame:
        group, ends, own, left = scan(group)
        out, count = [-1] * own, [1] * own
        for start in range(own - 1, -1, -1):
            if ends[start] < left:
                then = max(start + 1, int(ends[start]) - shared)
                if then >= own:
                    out[start] = then - own
                else:
                    out[start], count[start] = out[then], count[then] + 1
        return pd.DataFrame({"artifact_id": [group["artifact_id"].iloc[0]], "lane": [int(group["lane"].iloc[0])], "exits": [out[:most]], "counts": [count[:most]]})

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        rows, entry, number = [], 0, 0
        for name, lane, exits, counts in group.sort_values("lane")[["artifact_id", "lane", "exits", "counts"]].itertuples(index=False):
            rows.append((name, lane, entry, number))
            entry, number = int(exits[entry]), number + int(counts[entry])
            if entry < 0:
                break
        return pd.DataFrame(rows, columns=["_a", "_lane", "entry", "number"])

    def emit(group: pd.DataFrame) -> pd.DataFrame:
        start, number, rows = int(group["entry"].iloc[0]), int(group["number"].iloc[0]), []
        group, ends, own, left = scan(group)
        name, sizes, numbers = group["artifact_id"].iloc[0], group["size"].to_numpy(), group["sequence_no"].tolist()
        while start < own:
            end = int(ends[start])
            rows.append((name, number, numbers[start], numbers[end - 1], end - start, int(sizes[start:end].sum())))
            if end == left:
                break
            start, number = max(start + 1, end - shared), number + 1
        return pd.DataFrame(rows, columns=["artifact_id", "chunk_no", "first_no", "last_no", "n_items", "n_bytes"])

    long = lanes.where(F.col("n") > lane_rows)
    exits = long.groupBy("artifact_id", "lane").applyInPandas(leave, "artifact_id string, lane long, exits array<int>, counts array<int>")
    entries = exits.groupBy("artifact_id").applyInPandas(follow, "_a string, _lane long, entry int, number int")
    known = lanes.join(entries, F.col("artifact_id").eqNullSafe(F.col("_a")) & (F.col("lane") == F.col("_lane")), "left").where("lane = 0 or entry is not null")
    known = known.select("artifact_id", "sequence_no", "size", "pos", "n", "lane", F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("number", F.lit(0)).alias("number"))
    return known.groupBy("artifact_id", "lane").applyInPandas(emit, "artifact_id string, chunk_no int, first_no int, last_no int, n_items int, n_bytes long")


def richer(df: DataFrame, keys: list[str], texts: list[str], order: str) -> DataFrame:
    """One row per key with the longest value of each text (bytes; the first in ``order`` wins ties)."""
    best = lambda c: F.min_by(c, F.struct(-F.coalesce(F.octet_length(c), F.lit(-1)), F.col(order)))
    return df.groupBy(*keys).agg(*(best(c).alias(c) for c in texts), F.count("*").alias("n_merged"))


def merge_outputs(df: DataFrame, keys: list[str], texts: list[str], importance: str, summary: str, order: str, most: int = 20) -> DataFrame:
    """Outputs of several chunks merged per key: the richer texts, the largest importance, and the distinct summaries.

    Summaries are joined by blanks in ``order``, repeats once, up to ``most`` of them, so a key with
    many outputs gathers no more; null and blank ones are left out.
    """
    base = richer(df, keys, texts, order).join(df.groupBy(*keys).agg(F.max(importance).alias(importance)), keys)
    said = df.where(F.trim(F.coalesce(summary, F.lit(""))) != "").groupBy(*keys, F.trim(summary).alias("_s")).agg(F.min(order).alias("_o"))
    first = said.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("_o", "_s"))).where(F.col("_rn") <= most)
    joined = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_s"))), lambda x: x["_s"]), " ").alias(summary))
    return base.join(joined, keys, "left")


def upsert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key is not there yet (of new repeats, one)."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values over old ones where they are not null."""
    rest = [c for c in old.columns if c not in keys]
    joined = old.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in rest)).join(new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in rest)), keys, "full_outer")
    return joined.select(*keys, *(F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in rest))


def latest(log: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The current view of a change log: the last entry per key (partially aggregated, no window)."""
    rest = [c for c in log.columns if c not in keys and c != sequence]
    top = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("_r"))
    return top.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def supersede(objects: DataFrame, replaced: DataFrame) -> DataFrame:
    """Active objects of the artifacts in ``replaced(artifact_id)`` become superseded."""
    hit = replaced.select("artifact_id").distinct().withColumn("_hit", F.lit(True))
    status = F.when((F.col("object_status") == "active") & F.col("_hit"), "superseded").otherwise(F.col("object_status"))
    return objects.join(hit, "artifact_id", "left").withColumn("object_status", status).drop("_hit")


def change_status(objects: DataFrame, asked: DataFrame) -> DataFrame:
    """``(derived_object_id, object_status, replacement, outcome)`` of status changes ``(derived_object_id, to_status, replacement)``.

    Only active objects change, to superseded or rejected; a replacement is named only for the former.
    A change of an object that is not active, or not there, or to another status, is an error and
    changes nothing.  Of several changes of one object the least status counts.
    """
    one = asked.groupBy("derived_object_id").agg(F.min(F.struct("to_status", "replacement")).alias("c")).select("derived_object_id", "c.*")
    found = one.join(objects.select("derived_object_id", "object_status"), "derived_object_id", "left")
    fits = F.col("to_status").isin("superseded", "rejected")
    outcome = F.when(F.col("object_status").isNull(), "not_found").when(F.col("object_status") != "active", "not_active").when(~fits, "no_such_status").otherwise("changed")
    done = found.withColumn("outcome", outcome)
    status = F.when(F.col("outcome") == "changed", F.col("to_status")).otherwise(F.col("object_status"))
    return done.select("derived_object_id", status.alias("object_status"), F.when((F.col("outcome") == "changed") & (F.col("to_status") == "superseded"), F.col("replacement")).alias("replacement"), "outcome")


def agent_write(writes: DataFrame) -> DataFrame:
    """Objects written by an agent, ``writes(write_id, ...)``: active, each in a run named after its write."""
    return writes.withColumns({"derivation_run_id": F.concat(F.lit("agentrun-"), "write_id"), "object_status": F.lit("active"), "origin_kind": F.lit("agent")})


def cluster(df: DataFrame, group: str, key: str, text: Column, threshold: float = 0.9) -> DataFrame:
    """``(group, key, leader)``: greedy clusters in key order, the first similar leader wins.

    Depends on order and is not transitive, so a group is scanned in sequence; equal texts are
    collapsed before, which bounds a group of copies.  Similarity is the overlap of token sets over
    the smaller one, 1 for containment.  A text is compared with the leaders that share one of the
    tokens that similar ones must share, found by an index of tokens, not with all.
    """
    rows = df.select(group, key, text.alias("_t"))
    first = rows.groupBy(group, "_t").agg(F.min(key).alias("_first"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_clusters(part.sort_values("_first")[[group, "_first", "_t"]].itertuples(index=False), threshold), columns=[group, "_first", "leader"])

    led = first.groupBy(group).applyInPandas(run, f"{group} string, _first string, leader string").select("_first", "leader")
    named = first.select(F.col(group).alias("_g"), F.col("_t").alias("_u"), "_first")
    return rows.join(named, F.col(group).eqNullSafe(F.col("_g")) & F.col("_t").eqNullSafe(F.col("_u"))).join(led, "_first").select(group, key, "leader")


def _clusters(rows, threshold: float) -> list[tuple]:
    """``(group, id, leader)`` of one group's distinct texts in order.

    Of two sets with the overlap, all but ``ceil(threshold n) - 1`` tokens of the smaller one, in any
    fixed order, hold a shared one; and of a text inside another, every token but the first and last.
    """
    rows = list(rows)
    counts: dict[str, int] = {}
    split = [(t or "").split() for _, _, t in rows]
    for words in split:
        for w in set(words):
            counts[w] = counts.get(w, 0) + 1
    rare = lambda words: sorted(words, key=lambda w: (counts[w], w))
    leaders: list[tuple[str, str, set[str]]] = []
    by_token: dict[str, list[int]] = {}
    by_prefix: dict[str, list[int]] = {}
    short: list[int] = []  # texts of two tokens at most may lie inside others at parts of words
    out = []
    for (name, ident, t), listed in zip(rows, split):
        t, words = t or "", set(listed)
        found = None
        if t:
            ordered = rare(words)
            prefix = ordered[: len(ordered) - math.ceil(threshold * len(ordered) - 1e-9) + 1]
            inner = rare(set(listed[1:-1]))[:1]
            near = set(short) if len(listed) > 2 else set(range(len(leaders)))
            for w in (*prefix, *inner):
                near.update(by_token.get(w, ()))
            for w in words:
                near.update(by_prefix.get(w, ()))
            for k in sorted(near):
                lead, other, ws = leaders[k]
                if other and (t in other or other in t or (words and ws and len(words & ws) / min(len(words), len(ws)) >= threshold)):
                    found = lead
                    break
        if found is None:
            k = len(leaders)
            leaders.append((ident, t, words))
            if len(listed) <= 2:
                short.append(k)
            for w in words:
                by_token.setdefault(w, []).append(k)
            if t:
                for w in {*prefix, *inner}:
                    by_prefix.setdefault(w, []).append(k)
        out.append((name, ident, found or ident))
    return out


def drop_unresolved(relations: DataFrame, entities: DataFrame, subject: str, target: str, name: str) -> DataFrame:
    """Relations whose two ends are known names."""
    known = entities.select(name).distinct()
    return relations.join(known.withColumnRenamed(name, subject), subject, "left_semi").join(known.withColumnRenamed(name, target), target, "left_semi")
