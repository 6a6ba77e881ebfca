"""Deduplicating new batches against all accepted history, by an incremental prefix index.

A history lives in a folder and outlasts the session: :meth:`History.create` begins one,
:meth:`History.open` goes on with it, :meth:`History.accept` takes one batch.  It holds

* the index: postings ``(token, record, n, place)`` of accepted rows, bucketed by token;
* the accepted rows (identifier, update, texts), bucketed by record;
* every row seen with the fingerprint of its text and the accepted row that stands for it;
* the order of tokens.

A row's text is the set of its word shingles, taken message by message so that the order of messages
does not matter.  A set is ordered rare tokens first, by counts over the first batch.  Two sets with
Jaccard similarity ``t`` share a token among the first ``n - ceil(t n) + 1`` of each (the prefix), so
only prefixes are indexed.  A batch probes its prefixes; for a pair of rows of possible lengths the
shared prefix tokens are counted, and what the rest of both sets could add, and what lies behind the
first shared token, bound the overlap from above.  Pairs that may reach ``t`` are verified on the texts
of those rows, no others.  Rows of a batch meet one another the same way; verdicts are given in order of
arrival, and rows that stay are appended.

The measure: a row repeats another if the sets of their runs of three words agree to 0.66.  An edited
word spoils three such runs, so that is about seven edited words in a hundred, wherever they fall.
Runs of three are too common to search by; candidates are found by runs of ten words at 0.25, which
six edited words in a hundred leave where each spoils ten runs of its own, and more where edits are
closer to each other.  A pair has to reach both, and the sizes of its sets of ten-word runs must agree to 0.6.

Cost: a batch is read, tokenised and shuffled once.  Of the history, the thin postings are scanned
(bucket by bucket, never shuffled), the fingerprints are joined, and texts are read in the buckets
of candidate rows; few candidates prune the buckets.

Skew: identical texts are collapsed before anything is paired, also against history.  Near-copies of
an accepted row meet that one row, not each other, as rejected rows are not indexed.  A family of
near-copies that is new in a batch would pair quadratically, so lists of :data:`HOT` postings and more are
handled by their leaders first: the earliest row of every such list is decided exactly (with all rows
before it that it may depend on), the followers of accepted leaders are rejected, and so on until no more
follow.  Tokens that became frequent after the order was taken are no longer rare: where a batch's lists
promise more pairs than the index has rows, the order is taken anew and the index rebuilt.

Faults: a batch is a generation, whose number is never used twice and counts only once its commit
marker stands.  Rows of a batch that was cut off are ignored, and the index is then rebuilt from the
accepted rows, so it leaves no trace in later results.

Defined results: batches are taken by ``batch_no`` (null last), rows in a batch by ``record_id``; rows without words are
accepted and never indexed, rows without a record id ignored; null messages, texts and columns are
empty; a row that is a longer version (same identifier, later update, all messages of the accepted
row and more) is accepted; copies of one text share the verdict of their first; ties in similarity go
to the earlier row; an empty batch changes nothing; columns beside the named ones are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.durable import Workspace
from cairn.llm.shingles import BITS, ROWS, TokenBatch, mix

#: Candidates share runs of so many words to this degree, with sizes of this ratio at least, ...
SIZE, CANDIDATE, RATIO = 10, 0.25, 0.6
#: ... and repeat a row if their runs of so many words agree to this one.
FINE, THRESHOLD = 3, 0.66
#: The order counts tokens in so many slots (one byte each is broadcast).  It decides cost, never results.
SLOTS = 1 << 22
#: Postings lists of this length are handled by their leaders first.  It decides cost, never results.
HOT = 64
#: Up to so many candidate rows are named to the scan, which then prunes buckets.
NAMED = 1000

_ROW = "record_id long, owner long, updated long, texts array<string>"
_FEATURES = f"{_ROW}, fp long, n int, tokens array<long>, gen int"
_POSTING = "token long, a long, an int, apos int"
_SEEN = "record_id long, fp long, rep long, a long, fresh boolean, gen int"


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = min(1000, ROWS)) -> Iterator[pa.RecordBatch]:
    """Smaller batches: the arrays made of one are several times its size."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _batch_tokens(texts: pa.ListArray, size: int, messages: bool = False) -> TokenBatch:
    owner = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))
    return TokenBatch(texts.flatten().to_pylist(), owner, size, messages)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of one partition by slot, packed."""
    total = np.zeros(SLOTS, dtype=np.uint32)
    for batch in batches:
        tokens = batch.column("tokens").flatten().to_numpy(zero_copy_only=False)
        total += np.bincount(tokens & (SLOTS - 1), minlength=SLOTS).astype(np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)])], names=["packed"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, dtype=np.uint32)
    for batch in batches:
        for packed in batch.column("packed"):
            more = np.frombuffer(zlib.decompress(packed.as_py()), dtype=np.uint32)
            total = np.where(total > ~more, ~np.uint32(0), total + more)  # saturates
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)])], names=["packed"])


def token_order(features: DataFrame) -> np.ndarray:
    """How rare the tokens of each slot are, counted over all of ``features``, as one byte.

    Every partition counts into one array of :data:`SLOTS` slots; the arrays are added up on the
    executors, and a single one of 4 bytes a slot reaches the driver, whatever the size of the data.
    """
    packed = features.select("tokens").mapInArrow(_tally, "packed binary")
    one = packed.coalesce(16).mapInArrow(_add_up, "packed binary").repartition(1).mapInArrow(_add_up, "packed binary")
    found = one.first()
    total = np.frombuffer(zlib.decompress(found[0]), dtype=np.uint32) if found else np.zeros(SLOTS, dtype=np.uint32)
    order = np.minimum(total, 64).astype(np.uint8)  # exact up to 64, then by powers
    many = np.flatnonzero(total > 64)
    order[many] = (64 + 7 * np.log2(total[many] / 64)).astype(np.uint8)
    return order


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _featurise(batches: Iterator[pa.RecordBatch], gen: int) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        found, n = _batch_tokens(batch.column("texts"), SIZE), batch.num_rows
        size = np.bincount(found.row, minlength=n)
        some = np.flatnonzero(size)
        fp = np.zeros(n, dtype=np.int64)
        if len(some):
            total = np.add.reduceat(mix(found.token + np.uint64(1)), (np.cumsum(size) - size)[some])
            fp[some] = mix(total + size[some].astype(np.uint64)).view(np.int64)
        columns = [*(batch.column(c) for c in ("record_id", "owner", "updated", "texts")), pa.array(fp), pa.array(size.astype(np.int32)), _lists(found.row, found.token.view(np.int64), n), pa.array(np.full(n, gen, dtype=np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["record_id", "owner", "updated", "texts", "fp", "n", "tokens", "gen"])


def featurise(rows: DataFrame, gen: int = 0) -> DataFrame:
    """Rows ``(record_id, owner, updated, texts)`` with their fingerprint, token set and generation."""
    return rows.where("record_id is not null").select("record_id", "owner", "updated", "texts").mapInArrow(lambda batches: _featurise(batches, gen), _FEATURES)


def _prefix_length(n):
    """Tokens of a set of ``n`` among which a pair must share one."""
    if isinstance(n, Column):
        return n - F.ceil(n * CANDIDATE - 1e-9) + 1
    return n - np.ceil(n * CANDIDATE - 1e-9).astype(np.int64) + 1


def _prefixes(order):
    """Postings of rows: their prefixes in the order broadcast as ``order``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            lists = batch.column("tokens")
            token = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(size), dtype=np.uint64), size)
            rank = order.value[token & np.uint64(SLOTS - 1)].astype(np.uint64)
            # by row, rank and the leading bits of the token; sets are sorted, so ties stay in order
            key = (row << np.uint64(BITS)) | (rank << np.uint64(BITS - 8)) | (token >> np.uint64(8))
            token = token[np.argsort(key, kind="stable")]
            place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            inside = place < np.repeat(_prefix_length(size), size)
            each = lambda values: pa.array(np.repeat(values, size)[inside])
            ids = batch.column("record_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[inside].view(np.int64)), each(ids), each(size.astype(np.int32)), pa.array(place[inside].astype(np.int32))],
                names=["token", "a", "an", "apos"],
            )

    return run


def _agree(texts: pa.ListArray, size: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of the sets of rows ``2 i`` and ``2 i + 1``, and the ratio of their sizes."""
    found = _batch_tokens(texts, size)
    key = np.sort((found.row.astype(np.uint64) >> np.uint64(1) << np.uint64(BITS)) | found.token)
    both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(BITS)).astype(np.int64), minlength=pairs)
    sizes = np.bincount(found.row, minlength=2 * pairs).reshape(pairs, 2)
    return both / np.maximum(sizes.sum(axis=1) - both, 1), sizes.min(axis=1) / np.maximum(sizes.max(axis=1), 1)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """True pairs with their similarity; longer versions are none."""
    for batch in _sliced(batches, ROWS // 2):
        n = batch.num_rows
        texts = pa.concat_arrays([batch.column("ta"), batch.column("tb")]).take(pa.array(np.arange(2 * n).reshape(2, n).T.reshape(-1)))
        (score, _), (wide, ratio) = _agree(texts, FINE, n), _agree(texts, SIZE, n)
        same = (wide >= CANDIDATE - 1e-9) & (ratio >= RATIO - 1e-9) & (score >= THRESHOLD - 1e-9)
        later = pc.fill_null(pc.and_(pc.equal(batch.column("oa"), batch.column("ob")), pc.greater(batch.column("ub"), batch.column("ua"))), False).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(same & later):
            said = _batch_tokens(texts.slice(2 * i, 2), FINE, True)
            a, b = set(said.message[said.message_row == 0].tolist()), set(said.message[said.message_row == 1].tolist())
            same[i] = not a < b
        keep = pa.array(same)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(score[same])], names=["a", "b", "similarity"])


class History:
    """Accepted rows and their index; :meth:`accept` takes one batch after another."""

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.space = Workspace(spark, "history")
        self._tables: dict[str, str] = {}
        self.generation, self.version = self._committed()
        self._order = None

    # -- the folder -----------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int | None = None) -> History:
        """Begin a history in an empty folder that all executors share."""
        buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        Workspace.mark(spark, f"{path.rstrip('/')}/markers/buckets-{buckets}")
        return cls(spark, path, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        """Go on with a history."""
        names = [n for n in Workspace.names(spark, f"{path.rstrip('/')}/markers") if n.startswith("buckets-")]
        if len(names) != 1:
            raise FileNotFoundError(f"no history in {path}")
        return cls(spark, path, int(names[0].split("-")[1]))

    def _markers(self, kind: str) -> list[list[int]]:
        return [[int(x) for x in n.split("-")[1:]] for n in Workspace.names(self.spark, f"{self.path}/markers") if n.startswith(f"{kind}-")]

    def _committed(self) -> tuple[int, int]:
        """The last committed generation and the version of its index."""
        return tuple(max(self._markers("commit"), default=[0, 0]))

    def _dead(self) -> list[int]:
        """Generations that were begun and never committed."""
        return sorted({g for g, *_ in self._markers("begun")} - {g for g, *_ in self._markers("commit")})

    def _stale(self) -> bool:
        """Whether the index may hold postings of a batch that was cut off."""
        since = min((g for g, v in self._markers("begun") if v == self.version), default=0)
        return any(since <= g != self.generation for g in self._dead())

    def _alive(self, df: DataFrame) -> DataFrame:
        dead = [g for g in self._dead() if g != self.generation]
        return df.where(~F.col("gen").isin(dead)) if dead else df

    def _table(self, kind: str, schema: str, by: str) -> str:
        """The catalogue's name of a bucketed table of the folder."""
        where = f"{self.path}/{kind}"
        if where not in self._tables:
            name = f"cairn_{kind.replace('-', '_')}_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{where}'")
            self._tables[where] = name
        return self._tables[where]

    def _postings(self) -> str:
        return self._table(f"postings-{self.version}", _POSTING, "token")

    def _store(self) -> str:
        return self._table("store", f"{_ROW}, gen int", "record_id")

    def _append(self, name: str, rows: DataFrame, by: str, codec: str = "zstd") -> None:
        """Append to a bucketed table."""
        rows.select(self.spark.table(name).columns).write.bucketBy(self.buckets, by).format("parquet").option("compression", codec).mode("append").saveAsTable(name)

    def _seen(self) -> DataFrame:
        return self._alive(self.spark.read.schema(_SEEN).parquet(f"{self.path}/seen"))

    # -- the order of tokens --------------------------------------------------------------------

    def _ordered(self):
        """The order of this version of the index, broadcast once: a table of fixed size."""
        if self._order is None or self._order[0] != self.version:
            packed = self.spark.read.schema("packed binary").parquet(f"{self.path}/order-{self.version}").first()[0]
            self._order = self.version, self.spark.sparkContext.broadcast(np.frombuffer(zlib.decompress(bytes(packed)), dtype=np.uint8))
        return self._order[1]

    def _new_order(self, features: DataFrame) -> None:
        self.version = 1 + max([v for _, v in self._markers("begun")] + [self.version])
        Workspace.mark(self.spark, f"{self.path}/markers/begun-{self.generation}-{self.version}")
        packed = zlib.compress(token_order(features).tobytes(), 1)
        self.spark.createDataFrame([(bytearray(packed),)], "packed binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/order-{self.version}")

    def _stage(self, reps: DataFrame) -> DataFrame:
        """The batch's postings, bucketed by token like the index: their only shuffle."""
        name = f"cairn_stage_{uuid.uuid4().hex}"
        where = self.space.location("stage")
        self.spark.sql(f"CREATE TABLE {name} ({_POSTING}) USING parquet CLUSTERED BY (token) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        self._append(name, reps.select("record_id", "tokens").mapInArrow(_prefixes(self._ordered()), _POSTING).repartition(self.buckets, "token"), "token", "lz4_raw")
        self._tables[where] = name
        return self.spark.table(name)

    def _unstage(self) -> None:
        for where in [w for w in self._tables if w.startswith(self.space.path)]:
            self.spark.sql(f"DROP TABLE {self._tables.pop(where)}")
            self.space.drop(where)

    def _renew(self, reps: DataFrame) -> None:
        """Take the order anew over all accepted rows and the batch, and rebuild the index by it."""
        accepted = self.space.cut(featurise(self._alive(self.spark.table(self._store()))), "accepted")
        self._new_order(accepted.select("tokens").unionByName(reps.select("tokens")))
        rebuilt = accepted.where("n > 0").select("record_id", "tokens").mapInArrow(_prefixes(self._ordered()), _POSTING)
        self._append(self._postings(), rebuilt.repartition(self.buckets, "token"), "token")

    # -- pairs ----------------------------------------------------------------------------------

    def _meeting(self, later: DataFrame, index: DataFrame | None, within: DataFrame | None, name: str) -> DataFrame:
        """Pairs ``(a, b)`` of postings that may reach :data:`CANDIDATE`, stored.

        ``later`` meets the accepted rows of ``index`` and the earlier rows of ``within``.  Of two
        prefixes the one that ends first in the order holds all it shares with the other set in the
        other's prefix too; what lies behind it can add no more than its own length.  And nothing is
        shared before the first shared token.
        """
        b = later.select("token", F.col("a").alias("b"), F.col("an").alias("bn"), F.col("apos").alias("bpos")).hint("shuffle_hash")
        sides = []
        for rows, other in ((index, "a <> b"), (within, "a < b")):
            if rows is not None:
                met = b.join(rows.select("token", "a", "an", "apos"), "token").where(F.expr(other) & (F.least("an", "bn") >= RATIO * F.greatest("an", "bn") - 1e-9))
                packed = [F.shiftleft(F.col(x).cast("long"), 32) + F.col(y) for x, y in (("an", "bn"), ("apos", "bpos"))]
                sides.append(met.select("a", "b", packed[0].alias("size"), packed[1].alias("at")))
        shared = reduce(DataFrame.unionByName, sides).groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("size").alias("size"), F.min("at").alias("at"))
        parts = {n: f(F.col(c)) for c, (x, y) in (("size", ("an", "bn")), ("at", ("apos", "bpos"))) for n, f in ((x, lambda v: F.shiftright(v, 32)), (y, lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF))))}
        shared = shared.withColumns(parts)
        behind = F.greatest(F.col("an") - _prefix_length(F.col("an")), F.col("bn") - _prefix_length(F.col("bn")))
        need = CANDIDATE / (1 + CANDIDATE) * (F.col("an") + F.col("bn")) - 1e-9
        most = F.least(F.col("shared") + behind, F.col("an") - F.col("apos"), F.col("bn") - F.col("bpos"))
        return self.space.cut(shared.where(most >= need).select("a", "b"), name)

    def _verified(self, pairs: DataFrame, batch: DataFrame, history: bool, name: str) -> DataFrame:
        """``(a, b, similarity)`` of true pairs, stored.

        ``pairs`` is a stored table, so its size is known to the planner.  Accepted rows are read in
        their buckets; few candidates are named to the scan.
        """

        def side(df: DataFrame, s: str) -> DataFrame:
            return df.select(F.col("record_id").alias(s), F.col("texts").alias(f"t{s}"), F.col("owner").alias(f"o{s}"), F.col("updated").alias(f"u{s}"))

        full = pairs.hint("shuffle_hash").join(side(batch, "a"), "a")
        if history:
            stored = self._alive(self.spark.table(self._store()))
            few = [r[0] for r in pairs.select("a").limit(NAMED + 1).collect()]
            stored = stored.where(F.col("record_id").isin(sorted(set(few)))) if len(few) <= NAMED else stored
            full = full.unionByName(pairs.hint("shuffle_hash").join(side(stored, "a"), "a"))
        full = side(batch, "b").join(full.hint("shuffle_hash"), "b")
        judged = full.select("a", "b", "ta", "tb", "oa", "ob", "ua", "ub").mapInArrow(_judge, "a long, b long, similarity double")
        return self.space.cut(judged, name)

    def _settle(self, edges: DataFrame) -> DataFrame:
        """Of verified pairs, those whose earlier row is accepted.

        In order of arrival: a row without an undecided or accepted predecessor is accepted, and its
        successors are rejected.  ``edges`` holds every pair that its later rows are in.
        """
        done, left = edges.limit(0), edges
        while True:
            at = left.alias("e").join(left.select(F.col("b").alias("a")).distinct().withColumn("behind", F.lit(True)), "a", "left")
            out = at.where("behind is null").select(F.col("b").alias("a")).distinct().withColumn("out", F.lit(True))
            # pairs of rejected rows with accepted ones settled later still count for the best match
            state = F.when(F.col("behind").isNull(), "settled").when(F.col("out").isNull(), "left").otherwise("gone")
            told = self.space.cut(at.join(out, "a", "left").select("a", "b", "similarity", state.alias("state")), "settled")
            done = done.unionByName(told.where("state = 'settled'").drop("state"))
            left = told.where("state = 'left'").drop("state")
            if left.isEmpty():
                return done

    def _hot(self, staged: DataFrame) -> tuple[DataFrame, int, int]:
        """The leaders of long lists, the number of those, and the pairs that they would make."""
        lists = staged.groupBy("token").agg(F.count("*").alias("m"), F.min("a").alias("a")).where(F.col("m") >= HOT)
        n, pairs = lists.agg(F.count("*"), F.sum(F.col("m") * F.col("m"))).first()
        return (self.space.cut(lists.select("a").distinct(), "leaders") if n else lists.select("a")), n, pairs or 0

    def _families(self, staged: DataFrame, rows: DataFrame, leaders: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """Decide the leaders and reject their followers: ``(edges, decided rows)``, None if nothing followed.

        A leader depends on the rows before it that are like it, and these on theirs, so the leaders
        are closed under that first; within the closure the order of arrival decides.
        """
        space, closure, new, edges = self.space, leaders, leaders, None
        while not new.isEmpty():
            later = staged.join(new, "a", "left_semi")
            found = self._verified(self._meeting(later, None, staged, "before"), rows, False, "depends")
            edges = found if edges is None else edges.unionByName(found)
            new = space.cut(found.select("a").distinct().join(closure, "a", "left_anti"), "new")
            closure = closure.unionByName(new)
        decided = self._settle(edges)
        accepted = space.cut(closure.join(decided.select(F.col("b").alias("a")), "a", "left_anti"), "accepted")
        first, rest = staged.join(accepted, "a", "left_semi"), staged.join(closure, "a", "left_anti")
        followers = self._verified(self._meeting(rest, None, first, "follow"), rows, False, "followers")
        edges = decided.unionByName(followers)
        if edges.isEmpty():
            return None
        return edges, closure.unionByName(followers.select(F.col("b").alias("a")).distinct())

    # -- batches --------------------------------------------------------------------------------

    def accept(self, rows: DataFrame) -> DataFrame:
        """Take one batch ``(record_id, owner, updated, texts)``; returns ``(record_id_a, record_id_b)`` of its rejected rows."""
        spark, was = self.spark, (self.generation, self.version)
        # bucketed input stays in its buckets, also where no join asks for it
        setting = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
        before = spark.conf.get(setting)
        spark.conf.set(setting, "false")
        self.generation = 1 + max([g for g, *_ in self._markers("begun")] + [self.generation])
        Workspace.mark(spark, f"{self.path}/markers/begun-{self.generation}-{self.version}")
        try:
            rejected = self._accept(rows)
            Workspace.mark(spark, f"{self.path}/markers/commit-{self.generation}-{self.version}")
        except BaseException:
            self.generation, self.version = was
            raise
        finally:
            spark.conf.set(setting, before)
            self._unstage()
        return rejected

    def _accept(self, rows: DataFrame) -> DataFrame:
        space, first = self.space, not self.version
        stored = space.location("batch")  # read a few times and dropped: hashes do not compress
        featurise(rows, self.generation).write.option("compression", "lz4_raw").parquet(stored)
        batch = self.spark.read.schema(_FEATURES).parquet(stored)
        said = batch.where("n > 0")
        members = said.groupBy("fp").agg(F.min("record_id").alias("rep"), F.min("gen").alias("gen"))
        if first:
            members = members.withColumn("known", F.lit(None).cast("long"))
        else:
            members = members.join(self._seen().where("fresh").select("fp", F.coalesce("a", "rep").alias("known")), "fp", "left")
        members = space.cut(members, "members")
        reps = said.join(members.where("known is null").select(F.col("rep").alias("record_id")), "record_id", "left_semi")
        if first:
            self._new_order(reps)
        elif self._stale():
            self._renew(reps)
        staged = self._stage(reps)
        leaders, hot, promised = self._hot(staged)
        if not first and hot and promised > self.spark.table(self._postings()).count():
            self._renew(reps)
            self._unstage()
            staged = self._stage(reps)
            leaders, hot, _ = self._hot(staged)
        index = None if first else self.spark.table(self._postings())
        edges, left = None, staged
        if hot and not first:  # what history rejects leads nothing
            edges = self._verified(self._meeting(staged, index, None, "met"), batch, True, "hits")
            left, index = staged.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti"), None
            leaders, hot, _ = self._hot(left)
        while hot and (found := self._families(left, batch, leaders)):
            edges = found[0] if edges is None else edges.unionByName(found[0])
            left = left.join(space.cut(found[1], "decided"), "a", "left_anti")
            leaders, hot, _ = self._hot(left)
        near = self._settle(self._verified(self._meeting(left, index, left, "pairs"), batch, index is not None, "near"))
        edges = near if edges is None else edges.unionByName(near)
        best = space.cut(edges.groupBy("b").agg(F.max_by("a", F.struct("similarity", -F.col("a"))).alias("a")), "best")
        fresh = F.col("known").isNull() & (F.col("record_id") == F.col("rep"))
        seen = said.select("record_id", "fp").join(members, "fp").join(best.withColumnRenamed("b", "rep"), "rep", "left")
        seen = seen.select("record_id", "fp", "rep", F.coalesce("known", "a").alias("a"), fresh.alias("fresh"), "gen")
        out = best.select(F.col("b").alias("record_id"))
        kept = reps.join(out, "record_id", "left_anti").select("record_id", "owner", "updated", "texts", "gen")
        postings, store = self._postings(), self._store()
        self._append(postings, staged.join(out.withColumnRenamed("record_id", "a"), "a", "left_anti"), "token")
        self._append(store, kept.repartition(self.buckets, "record_id"), "record_id")
        seen.write.mode("append").option("compression", "zstd").parquet(f"{self.path}/seen")
        space.drop(stored)
        return self.rejected(self.generation)

    def rejected(self, generation: int | None = None) -> DataFrame:
        """``(record_id_a, record_id_b)`` of the rejected rows of one batch, or of all."""
        if not Workspace.names(self.spark, f"{self.path}/seen"):
            return self.spark.createDataFrame([], "record_id_a long, record_id_b long")
        rows = self._seen() if generation is None else self._seen().where(F.col("gen") == generation)
        rows = rows.where(F.col("a").isNotNull() | (F.col("record_id") != F.col("rep")))
        return rows.select(F.coalesce("a", "rep").alias("record_id_a"), F.col("record_id").alias("record_id_b"))

    def close(self) -> None:
        """Forget the catalogue's names of the tables; the folder stays and can be opened again."""
        for name in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables.clear()


def deduplicate(rows: DataFrame) -> DataFrame:
    """``(record_id_a, record_id_b)`` of all rejected rows of a series of batches.

    ``rows``: record_id, batch_no, owner (a number for the identifier), updated (microseconds), texts.
    Every ``batch_no`` is accepted as one batch, in order, nulls last, by a history of its own.
    """
    spark = rows.sparkSession
    space = Workspace(spark, "histories")
    state = History.create(spark, space.location("history"))
    numbers = [r[0] for r in rows.where("record_id is not null").select("batch_no").distinct().collect()]  # one row per batch
    for number in sorted(numbers, key=lambda n: (n is None, n or 0)):
        state.accept(rows.where(F.col("batch_no").eqNullSafe(F.lit(number))))
    out = space.cut(state.rejected(), "rejected")
    state.close()
    space.drop(state.path)
    return out
