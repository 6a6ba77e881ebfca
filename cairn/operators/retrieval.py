"""Lexical and semantic retrieval over text tables.

A single ranked search counts its terms in one scan of the texts, which then leave the plan: only
counts are shuffled.  Repeated searches use a stored index (:mod:`cairn.operators.lexical`), of which a
query reads the postings of its terms.  BM25 statistics (number of records, average length, document
frequency) are aggregates of either.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import vectors

K1, B = 1.2, 0.75
#: Base scores of the kinds of match, as documented for the set-level profile.
BASE = {"artifact_title": 240, "imported_note_tag": 380, "imported_note_alias": 370, "imported_note_path": 220, "derived_object": 360, "segment_excerpt": 300}


def terms(c: Column) -> Column:
    """Terms of a text: runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def counted(df: DataFrame, text: Column, query: list[str], *keep: str) -> DataFrame:
    """``keep``, the number of terms ``_len`` and the counts ``_f0``, ... of the query's terms in each text.

    Terms are counted by their runs; a text without a word as a part is not searched for it.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = df.select(*keep, low.alias("_low"), F.regexp_count(low, F.lit(r"[\p{L}\p{N}]+")).alias("_len"))
    alone = lambda w: F.regexp_count("_low", F.lit(rf"(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])"))
    return runs.select(*keep, "_len", *(F.when(F.contains("_low", F.lit(w)), alone(w)).otherwise(0).alias(f"_f{i}") for i, w in enumerate(sorted(set(query)))))


def bm25_counted(row: DataFrame, n_words: int, *keep: str) -> DataFrame:
    """``(*keep, score)`` of the counted records with any query term, by BM25; one row of statistics is broadcast."""
    stats = row.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(n_words)))
    scored = row.where(F.greatest(*(F.col(f"_f{i}") for i in range(n_words)), F.lit(0), F.lit(0)) > 0).crossJoin(F.broadcast(stats))
    return scored.select(*keep, sum((_bm25_part(F.col(f"_f{i}"), F.col("_len"), F.col("_n"), F.col("_avg"), F.col(f"_d{i}")) for i in range(n_words)), F.lit(0.0)).alias("score"))


def _bm25_part(tf: Column, length: Column, n: Column, mean: Column, df: Column) -> Column:
    idf = F.greatest(F.lit(1e-6), F.log((n - df + 0.5) / (df + 0.5)))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(df: DataFrame, key: str, text: Column, query: list[str]) -> DataFrame:
    """``(key, score)`` of the records with any query term, by BM25."""
    words = sorted(set(query))
    return bm25_counted(counted(df, text, words, key), len(words), key)


@dataclass
class Query:
    """A search text: plain words, or an operator expression with quotes, AND, OR, NOT, prefix*."""

    text: str
    words: list[str] = field(default_factory=list)
    operators: bool = False

    def __post_init__(self) -> None:
        self.operators = is_operator_query(self.text)
        self.words = plain_words(self.text)


def plain_words(text: str) -> list[str]:
    """The distinct terms of a query in order."""
    import re

    return list(dict.fromkeys(re.findall(r"[^\W_]+", text.lower())))


def is_operator_query(text: str) -> bool:
    """Whether a query uses operators and is well formed (quotes and brackets balance)."""
    import re

    if text.count('"') % 2:
        return False
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    if depth:
        return False
    return '"' in text or bool(re.search(r"(?:^|\s)(?:AND|OR|NOT|NEAR(?:/\d+)?)(?:\s|$)|(?:^|\s)-\w|\w\*(?:\s|$)", text))


def matches(text: Column, expression: str) -> Column:
    """A boolean column for an operator expression: "phrases", AND, OR, NOT, -term, prefix*, brackets.

    Adjacent terms mean AND.  Phrases are matched on the blank-joined terms.  ``a NEAR/n b`` asks for
    at most n terms between two plain terms, in either order (10 without a number).
    """
    import re

    joined = F.concat(F.lit(" "), F.array_join(terms(text), " "), F.lit(" "))
    tokens = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', expression)
    at = 0

    def atom() -> Column:
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "(":
            inner = either()
            at += 1
            return inner
        if t == "NOT":
            return ~atom()
        if t.startswith("-") and len(t) > 1:
            return ~joined.contains(f" {t[1:].lower()} ")
        if t.startswith('"'):
            return joined.contains(f" {' '.join(plain_words_all(t))} ")
        if t.endswith("*"):
            return joined.contains(f" {t[:-1].lower()}")
        if at + 1 < len(tokens) and (near := re.fullmatch(r"NEAR(?:/(\d+))?", tokens[at])):
            a, b, n = t.lower(), tokens[at + 1].lower(), int(near.group(1) or 10)
            at += 2
            gap = rf"(?:[^ ]+ ){{0,{n}}}"
            return joined.rlike(rf" (?:{re.escape(a)} {gap}{re.escape(b)}|{re.escape(b)} {gap}{re.escape(a)}) ")
        return joined.contains(f" {t.lower()} ")

    def both() -> Column:
        nonlocal at
        out = atom()
        while at < len(tokens) and tokens[at] not in ("OR", ")"):
            if tokens[at] == "AND":
                at += 1
            out = out & atom()
        return out

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] == "OR":
            at += 1
            out = out | both()
        return out

    return either()


def plain_words_all(text: str) -> list[str]:
    """All terms of a phrase, repeats kept."""
    import re

    return re.findall(r"[^\W_]+", text.lower())


def hint(base: int, score: Column) -> Column:
    """A match's score: the base of its kind and a bonus of ten times the rank, not below 0."""
    return (base + F.greatest(F.lit(0), F.round(score * 10).cast("int"))).cast("int")


#: Weights of text classes in the cover-density rank: titles A, bodies B, unclassed text D.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def cover_density(texts: dict[str, Column], query: list[str]) -> Column:
    """Cover-density rank of a query that any of its words satisfies, over texts by weight class.

    For such a query every occurrence of a word is a cover of its own, of one lexeme and without
    noise, so the rank is the sum of the classes' weights over all occurrences.  Words are compared
    unstemmed.
    """
    words = sorted(set(query))
    hits = [WEIGHTS[c] * F.size(F.filter(terms(t), lambda x: x.isin(*words))) for c, t in texts.items()]
    return sum(hits[1:], hits[0])


def cover_all(texts: dict[str, Column], query: list[str]) -> Column:
    """Cover-density rank of a query that asks for all of its words.

    A cover is a shortest stretch of the text with every word in it; it counts the harmonic mean of
    its words' weights, divided by one more than the other terms inside.  Covers are the stretches
    between a word and the nearest earlier place by which all words have been seen, kept where no
    later start does as well.  0 where a word is missing.  Positions run on through the classes.
    """
    words = sorted(set(query))
    each = [_weighed(t, 1 / WEIGHTS[c]) for c, t in texts.items()]
    line = F.concat(*each) if len(each) > 1 else each[0]
    hits = F.filter(F.transform(line, lambda x, i: F.struct(x["w"].alias("w"), x["v"].alias("v"), i.alias("i"))), lambda x: x["w"].isin(*words))
    none = F.lit(-1).cast("int")
    start = F.struct(*(F.struct(none.alias("i"), F.lit(0.0).alias("v")).alias(f"w{k}") for k in range(len(words))), none.alias("taken"), F.lit(0.0).alias("rank"))

    def step(acc: Column, x: Column) -> Column:
        last = [F.when(x["w"] == w, F.struct(x["i"].alias("i"), x["v"].alias("v"))).otherwise(acc[f"w{k}"]) for k, w in enumerate(words)]
        first = F.least(*(p["i"] for p in last)) if len(last) > 1 else last[0]["i"]
        fresh = (first >= 0) & (first > acc["taken"])
        noise = x["i"] - first - (len(words) - 1)
        worth = len(words) / sum((p["v"] for p in last[1:]), last[0]["v"]) / (1 + F.greatest(noise, F.lit(0)))
        return F.struct(*(p.alias(f"w{k}") for k, p in enumerate(last)), F.when(fresh, first).otherwise(acc["taken"]).alias("taken"), (acc["rank"] + F.when(fresh, worth).otherwise(0.0)).alias("rank"))

    return F.aggregate(hits, start, step, lambda acc: acc["rank"])


def _weighed(text: Column, weight: float) -> Column:
    return F.transform(terms(text), lambda x: F.struct(x.alias("w"), F.lit(weight).alias("v")))


def rank_hint(base: int, rank: Column) -> Column:
    """A match's score under cover density: the base of its kind plus a hundred times the rank, cut off."""
    return (base + F.greatest(F.lit(0), F.floor(F.round(rank * 100, 6)).cast("int"))).cast("int")


def link_score(url: Column, display: Column, word: Column) -> Column:
    """The score of an external link: by its address, wholly or in part, by its shown text, or by its target only."""
    url, display = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(display, F.lit("")))
    return F.when(url == word, 395).when(url.contains(word), 390).when(display.contains(word), 250).otherwise(230)


def candidates(art: DataFrame, tags: DataFrame, aliases: DataFrame, links: DataFrame, objects: DataFrame, segments: DataFrame, texts: list[str]) -> DataFrame:
    """Matches of all seven kinds for each of ``texts``, with the fields that matched, not yet cut.

    ``(query_text, artifact_id, match_record_id, match_kind, snippet, score_hint, matched_fields)``.
    ``aliases(artifact_id, alias, alias_text)`` are normalised, ``links(artifact_id, seq, external_url,
    display_text, raw_target)`` external, ``objects`` active.  All texts are looked for in one pass.
    """
    word = F.lower("query_text")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    has = lambda c: low(c).contains(word)
    asked = F.explode(F.array(*(F.lit(t) for t in texts))).alias("query_text")

    def rows(df: DataFrame, kind: str, hit: Column, record: Column, snippet: Column, fields: dict[str, Column], score: Column | None = None) -> DataFrame:
        score = F.lit(BASE[kind]) if score is None else score
        which = F.array_compact(F.array(*(F.when(test, name) for name, test in fields.items())))
        return df.select("*", asked).where(hit).select("query_text", "artifact_id", record.alias("match_record_id"), F.lit(kind).alias("match_kind"), snippet.alias("snippet"), score.alias("score_hint"), which.alias("matched_fields"))

    always = F.lit(True)
    both = F.concat_ws(" ", low(F.col("title")), low(F.col("body_text")))
    in_link = {c: has(F.col(c)) for c in ("external_url", "display_text", "raw_target")}
    branches = [
        rows(art.select("artifact_id", "title"), "artifact_title", has(F.col("title")), F.col("artifact_id"), F.coalesce("title", F.lit("")), {"title": always}),
        rows(tags, "imported_note_tag", F.col("tag") == word, F.concat_ws("#", "artifact_id", "seq"), F.col("tag"), {"tag": always}),
        rows(aliases, "imported_note_alias", F.col("alias") == word, F.concat_ws("#", "artifact_id", "alias"), F.col("alias_text"), {"alias": always}),
        rows(art.select("artifact_id", "path_key"), "imported_note_path", has(F.col("path_key")), F.col("artifact_id"), F.coalesce("path_key", F.lit("")), {"path": always}),
        rows(links, "imported_external_link", in_link["external_url"] | in_link["display_text"] | in_link["raw_target"], F.concat_ws("#", "artifact_id", "seq"), F.coalesce("display_text", "external_url", "raw_target", F.lit("")), in_link, link_score(F.col("external_url"), F.col("display_text"), word)),
        rows(objects.select("artifact_id", "derived_object_id", "title", "body_text"), "derived_object", both.contains(word), F.col("derived_object_id"), F.coalesce("title", "body_text", F.lit("")), {"title": has(F.col("title")), "body_text": has(F.col("body_text"))}),
        rows(segments, "segment_excerpt", has(F.col("text_content")), F.col("segment_id"), F.left(F.coalesce("text_content", F.lit("")), F.lit(240)), {"text_content": always}),
    ]
    return reduce(DataFrame.unionByName, branches)


def best_per(df: DataFrame, key: str, score: str, *ties: str) -> DataFrame:
    """The best row of each key (a rank filter)."""
    w = Window.partitionBy(key).orderBy(F.desc(score), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def blend(lexical: DataFrame, semantic: DataFrame, key: str) -> DataFrame:
    """Full outer merge of two rankings ``(key, score)``: 0.4 of s/(s+1) and 0.6 of the similarity.

    Lexical hits alone keep their 0.4 share, semantic hits alone their whole similarity.
    """
    lx = lexical.select(key, F.when(F.col("score") > 0, F.col("score") / (F.col("score") + 1)).otherwise(0.0).alias("lex"))
    sm = semantic.select(key, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("sem"))
    both = lx.join(sm, key, "full_outer")
    score = F.when(F.col("sem").isNull(), F.col("lex") * 0.4).when(F.col("lex").isNull(), F.col("sem")).otherwise(F.col("lex") * 0.4 + F.col("sem") * 0.6)
    return both.select(key, score.alias("score"))


def knn(df: DataFrame, key: str, vector: str, query: Column, k: int) -> DataFrame:
    """The ``k`` nearest records by cosine similarity, ties by key."""
    return df.select(key, vectors.cosine(F.col(vector), query).alias("score")).orderBy(F.desc("score"), key).limit(k)


def batch_knn(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int, group: str | None = None, block_bytes: int | None = None, other: str | None = None) -> DataFrame:
    """The ``k`` nearest of all ``corpus`` rows for each query: ``(query_id, key, similarity, rank)``.

    Exact, in blocks: every partition of the corpus is compared with a block of queries by matrix
    products and keeps its ``k`` best per query as it goes, so only ``k`` rows per query and partition
    are shuffled.  A block is bounded by its bytes; query sets beyond one block are stored and taken
    block by block, each a scan of the corpus, with the same result.  ``group``: a column in which
    neighbours must agree with the query (null with null); ``other``: one in which they must differ.  A query is not its own neighbour; null
    vectors are neither queries nor neighbours; vectors of other lengths than the query's are none.
    """
    columns = [key, vector] + [c for c in (group, other) if c]
    stated = queries.select(*columns).where(F.col(vector).isNotNull())
    total = stated.agg(F.sum(F.size(vector) * 8 + 64)).first()[0] or 0
    blocks = max(1, -(-total // (block_bytes or BLOCK_BYTES)))
    if blocks > 1:
        from cairn.durable import Workspace

        stated = Workspace(corpus.sparkSession, "knn").cut(stated.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), "queries", ["_block"])
    found = [_knn_block(corpus.select(*columns), stated.where(F.col("_block") == b) if blocks > 1 else stated, key, vector, k, group, other) for b in range(blocks)]
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), key)
    near = reduce(DataFrame.unionByName, found)
    return near.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def _knn_block(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int, group: str | None, other: str | None) -> DataFrame:
    import numpy as np
    import pandas as pd

    columns = [key, vector] + [c for c in (group, other) if c]
    stated = queries.select(*columns).toPandas()  # at most about BLOCK_BYTES
    ids = stated[key].to_numpy()
    width = max((len(v) for v in stated[vector]), default=1)
    fits = [len(v) == width for v in stated[vector]]

    def unit(rows) -> np.ndarray:
        x = np.array([np.asarray(v, dtype=np.float64) for v in rows]).reshape(-1, width)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    if not all(fits):  # sets of mixed lengths: one length at a time
        lengths = queries.select(F.size(vector).alias("n")).distinct().collect()
        return reduce(DataFrame.unionByName, [_knn_block(corpus, queries.where(F.size(vector) == n), key, vector, k, group, other) for (n,) in lengths])
    q = unit(stated[vector])
    values = lambda frame, column: frame[column].astype(object).where(frame[column].notna(), None).to_numpy()[None, :] if column else None
    ours, elsewhere = values(stated, group), values(stated, other)

    def best(parts: list) -> pd.DataFrame:
        near = pd.concat(parts, ignore_index=True)
        near["_r"] = near["similarity"].round(9)
        near = near.sort_values(["query_id", "_r", key], ascending=[True, False, True], kind="stable")
        return near[near.groupby("query_id").cumcount() < k].drop(columns="_r")

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            batch = batch[batch[vector].map(lambda v: v is not None and len(v) == width)]
            if not len(batch) or not len(ids):
                continue
            x, own = unit(batch[vector]), batch[key].to_numpy()
            same, apart = values(batch, group), values(batch, other)
            for lo in range(0, len(ids), 1024):
                s = q[lo : lo + 1024] @ x.T
                s[ids[lo : lo + 1024, None] == own[None, :]] = -2.0
                if group:
                    s[ours.T[lo : lo + 1024] != same] = -2.0
                if other:
                    s[elsewhere.T[lo : lo + 1024] == apart] = -2.0
                m = min(k, s.shape[1])
                kth = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
                at, of = np.nonzero((s >= kth - 1e-9) & (s > -1.5))  # ties at the edge are settled by key
                held.append(pd.DataFrame({"query_id": ids[lo + at], key: own[of], "similarity": np.maximum(s[at, of], 0.0)}))
                rows += len(at)
            if rows > 8 * k * len(ids) + 100_000:
                held = [best(held)]
                rows = len(held[0])
        if held:
            yield best(held)

    return corpus.mapInPandas(run, f"query_id {dict(queries.dtypes)[key]}, `{key}` {dict(corpus.dtypes)[key]}, similarity double")


#: Bytes of query vectors that are sent to every task at once.
BLOCK_BYTES = 64 << 20
