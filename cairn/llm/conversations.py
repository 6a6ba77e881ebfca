"""Rebuilding conversations from message rows.

Input rows are single messages, scattered over records, repeated and out of order.  They are
reduced to one row per message identifier, brought into time order, and each conversation is either
kept, with numbered turns, or rejected with a reason.

Clocks: with ``u`` and ``a`` the user's and the assistant's turns on a common clock, every user turn
comes before its reply and every reply before the next user turn.  The two senders' clocks may differ;
each source's assistants have one offset ``d``, and a conversation whose turns pair up allows an
interval for it.  ``d`` is the least-squares fit: it makes the sum of squared distances to the intervals
least, over the conversations that agree on a clock at all (those whose own least correction lies
within three robust deviations of the median; broken conversations ask for anything), and among equal
fits it is the one nearest to 0.  Assistants' times are corrected by it, turns are merged in the order
of corrected times, and a conversation whose constraints then do not hold is infeasible and rejected.
:func:`estimate_shift` states the interval rule for a single conversation.

Skew: a conversation may hold a third of all rows, so none is ever gathered in one task.  Rows are
range-partitioned by (conversation, time), which spreads a hot conversation over many tasks; a scan
of each sorted partition gives every row its predecessor's role and its rank, and per-partition summaries
(one row per conversation and partition) are combined in time order.  Turns pair up by rank, so the fit
groups by (conversation, rank) and then reduces to one interval per conversation.

Defined results: a null conversation identifier drops the row; a null message identifier makes each
row its own message; copies of a message count once, at the earliest recorded time; ties in time go
by place in the export; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cairn.durable import Workspace

NEVER = np.iinfo(np.int64).max
MENTION, MARK, USER, ASSISTANT, OTHER, BAD = -2, -1, 0, 1, 2, 3

REASONS = ("orphaned", "empty", "malformed", "no_turns", "starts_without_user", "ends_without_reply", "user_twice")


def role(sender: Column) -> Column:
    """Role code of a sender name in any case; unknown names are BAD."""
    name = F.lower(F.trim(F.coalesce(sender, F.lit(""))))
    return F.when(name.isin("human", "user"), USER).when(name == "assistant", ASSISTANT).when(name.isin("system", "tool"), OTHER).otherwise(BAD)


def estimate_shift(user: list[int], assistant: list[int]) -> int | None:
    """Least-squares shift of the assistant's clock under the reply-before constraints.

    Turns pair up in each sender's own order: ``user[k] < assistant[k] + d < user[k + 1]``.  The
    squared correction ``d * d`` is least at the feasible value nearest to 0.  None: infeasible.
    """
    if not user or len(user) != len(assistant):
        return None
    u, a = np.sort(np.array(user, dtype=np.int64)), np.sort(np.array(assistant, dtype=np.int64))
    low = int(np.max(u - a)) + 1
    high = int(np.min(u[1:] - a[:-1])) - 1 if len(u) > 1 else np.iinfo(np.int64).max
    return None if low > high else min(max(0, low), high)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add to sorted rows: the role before, the row's rank, its rank among its role, and the partition."""
    part = TaskContext.get().partitionId()
    last: tuple = (None, None)
    role_before, counts = MARK, {MARK: 0, USER: 0, ASSISTANT: 0}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        code, at = batch.column("code").to_numpy(zero_copy_only=False), np.arange(n)
        starts = np.zeros(n, dtype=bool)
        for k, name in enumerate(("source", "conversation_id")):
            column = batch.column(name)
            starts[0] |= column[0].as_py() != last[k]
            starts[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        begin = np.maximum.accumulate(np.where(starts, at, -1))  # -1: begun in an earlier batch
        first = np.maximum(begin, 0)

        def rank(counted: np.ndarray, carried: int) -> np.ndarray:
            total = np.cumsum(counted) - counted
            return total - total[first] + np.where(begin < 0, carried, 0)

        turn = (code == USER) | (code == ASSISTANT)
        seen = np.r_[-1, np.maximum.accumulate(np.where(turn, at, -1))[:-1]]
        before = np.where(seen >= first, code[np.maximum(seen, 0)], np.where(begin < 0, role_before, MARK))
        said = code > MARK
        ranks, own = rank(said, counts[MARK]), np.zeros(n, dtype=np.int64)
        for c in (USER, ASSISTANT):
            mine = rank(code == c, counts[c])
            own = np.where(code == c, mine, own)
            counts[c] = int(mine[-1]) + int(code[-1] == c)
        counts[MARK] = int(ranks[-1]) + int(said[-1])
        role_before = int(code[-1] if turn[-1] else before[-1])
        last = batch.column("source")[n - 1].as_py(), batch.column("conversation_id")[n - 1].as_py()
        added = [pa.array(before.astype(np.int32)), pa.array(ranks.astype(np.int64)), pa.array(own), pa.array(np.full(n, part, dtype=np.int32))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "before", "rank", "own", "part"])


def _ordered(flat: DataFrame, space: Workspace) -> DataFrame:
    """Rows in time order with what :func:`_scan` adds, stored."""
    order = ["source", "conversation_id", "t", "pos"]
    ordered = flat.repartitionByRange(*order).sortWithinPartitions(*order).drop("pos")
    added = [StructField(name, kind) for name, kind in (("before", IntegerType()), ("rank", LongType()), ("own", LongType()), ("part", IntegerType()))]
    return space.cut(ordered.mapInArrow(_scan, StructType([*ordered.schema.fields, *added])), "ordered")


def _intervals(scanned: DataFrame) -> DataFrame:
    """``(source, low, high)``: the offsets of the assistants' clock that each conversation allows."""
    keys = ["source", "conversation_id"]
    turns = scanned.where(F.col("code").isin(USER, ASSISTANT) & (F.col("t") < NEVER))
    # only conversations across partitions need their ranks moved: at most two rows a partition
    count = lambda c: F.count_if(F.col("code") == c)
    parts = turns.groupBy(*keys, "part").agg(F.struct(F.min("t").alias("t0"), "part", count(USER).alias("u"), count(ASSISTANT).alias("a")).alias("p"))
    spans = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("ps")).where(F.size("ps") > 1)
    before = lambda i, n: F.aggregate(F.slice("ps", 1, i), F.lit(0).cast("long"), lambda acc, q: acc + q[n]).alias(n)
    ahead = F.transform("ps", lambda p, i: F.struct(p["part"].alias("part"), before(i, "u"), before(i, "a")))
    moved = spans.select(*keys, F.explode(ahead).alias("m")).select(*keys, F.col("m.part").alias("part"), "m.u", "m.a")
    ranked = turns.join(F.broadcast(moved), [*keys, "part"], "left")
    k = F.col("own") + F.coalesce(F.when(F.col("code") == USER, F.col("u")).otherwise(F.col("a")), F.lit(0))
    # a user turn is the first of its own pair and the end of the pair before
    places = F.when(F.col("code") == USER, F.array(F.struct(k.alias("k"), F.lit("u").alias("as")), F.struct((k - 1).alias("k"), F.lit("next").alias("as"))))
    places = F.coalesce(places, F.array(F.struct(k.alias("k"), F.lit("a").alias("as"))))
    placed = ranked.select(*keys, "t", F.explode(places).alias("x")).select(*keys, "t", "x.k", F.col("x.as").alias("role")).where("k >= 0")
    pick = lambda name: F.max(F.when(F.col("role") == name, F.col("t")))
    pairs = placed.groupBy(*keys, "k").agg(pick("u").alias("u"), pick("a").alias("a"), pick("next").alias("next"))
    each = pairs.groupBy(*keys).agg(
        (F.max(F.col("u") - F.col("a")) + 1).alias("low"),
        F.coalesce(F.min(F.col("next") - F.col("a")) - 1, F.lit(NEVER)).alias("high"),
        F.bool_and(F.col("u").isNotNull() & F.col("a").isNotNull()).alias("paired"),
    )
    return each.where(F.col("paired") & (F.col("low") <= F.col("high"))).select("source", "low", "high")


def estimate_offsets(intervals: DataFrame) -> dict[str, int]:
    """The least-squares offset of every source from ``(source, low, high)``; one row per source reaches the driver."""
    least = F.least(F.greatest(F.lit(0).cast("long"), "low"), "high")
    x = intervals.select("source", "low", "high", least.alias("x"))
    middle = x.groupBy("source").agg(F.percentile_approx("x", 0.5, 10_000).alias("m"))
    x = x.join(F.broadcast(middle), "source").withColumn("off", F.abs(F.col("x") - F.col("m")))
    spread = x.groupBy("source").agg(F.percentile_approx("off", 0.5, 10_000).alias("s"))
    agreeing = x.join(F.broadcast(spread), "source").where(F.col("off") <= 3 * 1.4826 * F.col("s"))
    out, open_ = {}, {}
    for source, low, high in agreeing.groupBy("source").agg(F.max("low"), F.min("high")).collect():
        if low <= high:
            out[source] = min(max(0, low), high)
        else:
            open_[source] = (high, low)
    steps = 32
    while open_:  # the slope of the squares changes sign between the least high and the largest low
        grid = {s: [b + (a - b) * i / steps for i in range(steps + 1)] for s, (b, a) in open_.items()}
        of = F.create_map(*(v for s, g in grid.items() for v in (F.lit(s), F.array(*map(F.lit, g)))))[F.col("source")]
        slope = [F.sum(F.greatest(of[i] - F.col("high"), F.lit(0.0)) - F.greatest(F.col("low") - of[i], F.lit(0.0))) for i in range(steps + 1)]
        for source, *slopes in agreeing.where(F.col("source").isin(list(open_))).groupBy("source").agg(*slope).collect():
            i = max(1, next(i for i, v in enumerate(slopes) if v >= 0))
            b, a = grid[source][i - 1], grid[source][i]
            open_[source] = (b, a)
            if a - b < 1:
                out[source] = round(a)
                del open_[source]
    return out


def _corrected(flat: DataFrame, offsets: dict[str, int]) -> DataFrame:
    """Assistants' times on the users' clock."""
    of = F.create_map(*(F.lit(v) for pair in offsets.items() for v in pair))[F.col("source")]
    ours = (F.col("code") == ASSISTANT) & (F.col("t") < NEVER)
    return flat.withColumn("t", F.when(ours, F.col("t") + F.coalesce(of, F.lit(0))).otherwise(F.col("t")).cast("long"))


class Rebuilt:
    """The result of :func:`rebuild`; ``offsets`` are the corrections of the assistants' clocks by source."""

    def __init__(self, rows: DataFrame, verdicts: DataFrame, offsets: dict[str, int]) -> None:
        self._rows, self.verdicts, self.offsets = rows, verdicts, offsets

    def rejected(self) -> DataFrame:
        """``(source, conversation_id, reason)`` of the conversations to drop."""
        return self.verdicts.where(F.col("reason").isNotNull()).select("source", "conversation_id", "reason")

    def turns(self) -> DataFrame:
        """Ordered turns of the kept conversations: place, role, time and message key."""
        names = F.create_map(*(F.lit(x) for pair in ((USER, "user"), (ASSISTANT, "assistant"), (OTHER, "system")) for x in pair))
        kept = self.verdicts.where(F.col("reason").isNull()).select("source", "conversation_id", F.explode("parts").alias("p"))
        offsets = kept.select("source", "conversation_id", F.col("p.part").alias("part"), F.col("p.offset").alias("offset"))
        rows = self._rows.where(F.col("code") > MARK).join(offsets, ["source", "conversation_id", "part"])
        return rows.select("source", "conversation_id", (F.col("offset") + F.col("rank")).alias("turn_no"), names[F.col("code")].alias("role"), F.col("t").alias("utc_us"), "message_id")


def rebuild(messages: DataFrame, conversations: DataFrame, mentioned: DataFrame | None = None, offsets: dict[str, int] | None = None) -> Rebuilt:
    """Order messages into conversations and judge each conversation.

    ``messages``: source, conversation_id, message_id, sender, t (microseconds or null), pos (place
    in the export, a struct or number), of messages with text.  ``conversations``: source,
    conversation_id of the records that bear an identifier; ``mentioned``: the same of further
    conversations to judge, which no record may bear.  ``offsets`` states the corrections of the
    assistants' clocks instead of estimating them.
    """
    space = Workspace(messages.sparkSession, "conversations")
    code = F.when(F.col("t").isNull(), BAD).otherwise(role(F.col("sender")))
    identity = F.coalesce("message_id", F.concat(F.lit("\u0000"), F.col("pos").cast("string")))
    copies = messages.where(F.col("conversation_id").isNotNull()).select("source", "conversation_id", identity.alias("message_id"), F.coalesce("t", F.lit(NEVER)).alias("t"), "pos", code.alias("code"))
    first = copies.groupBy("source", "conversation_id", "message_id").agg(F.min(F.struct("t", "pos", "code")).alias("m"))
    rows = first.select("source", "conversation_id", "message_id", "m.t", "m.pos", "m.code")
    absent = {"message_id": "string", "pos": rows.schema["pos"].dataType}
    for names, mark in ((conversations, MARK), (mentioned, MENTION)):
        if names is not None:
            one = names.where(F.col("conversation_id").isNotNull()).select("source", "conversation_id").distinct()
            rows = rows.unionByName(one.select("*", *(F.lit(None).cast(k).alias(n) for n, k in absent.items()), F.lit(np.iinfo(np.int64).min).alias("t"), F.lit(mark).alias("code")))
    # sampling for the range partitioning must not recompute the messages, so they are cut here
    flat = space.cut(rows.withColumn("code", F.col("code").cast("int")), "messages")
    scanned = _ordered(flat, space)
    if offsets is None:
        offsets = estimate_offsets(space.cut(_intervals(scanned), "intervals"))
    if any(offsets.values()):  # else the order stands
        scanned = _ordered(_corrected(flat, offsets), space)
    turn = F.col("code").isin(USER, ASSISTANT)
    place = F.struct("t", "rank")
    parts = scanned.groupBy("source", "conversation_id", "part").agg(
        F.min("t").alias("t0"),
        F.count_if(F.col("code") > MARK).alias("n"),
        F.count_if(F.col("code") == MARK).alias("marks"),
        F.count_if(F.col("code") == BAD).alias("bad"),
        F.min_by(F.when(turn, F.col("code")), F.when(turn, place)).alias("first"),
        F.max_by(F.when(turn, F.col("code")), F.when(turn, place)).alias("last"),
        F.count_if((F.col("code") == USER) & (F.col("before") == USER)).alias("twice"),
    )
    # one entry per partition that the conversation touches
    whole = parts.groupBy("source", "conversation_id").agg(F.array_sort(F.collect_list(F.struct("t0", "part", "n", "marks", "bad", "first", "last", "twice"))).alias("ps"))
    total = lambda f: F.aggregate("ps", F.lit(0).cast("long"), lambda acc, p: acc + p[f])
    spoken = F.filter("ps", lambda p: p["first"].isNotNull())
    seam = F.aggregate(
        spoken,
        F.struct(F.lit(MARK).alias("last"), F.lit(0).cast("long").alias("twice")),
        lambda acc, p: F.struct(p["last"].alias("last"), (acc["twice"] + F.when((acc["last"] == USER) & (p["first"] == USER), 1).otherwise(0)).cast("long").alias("twice")),
    )
    judged = whole.withColumn("spoken", spoken)
    reason = (
        F.when(total("marks") == 0, "orphaned")
        .when(total("n") == 0, "empty")
        .when(total("bad") > 0, "malformed")
        .when(F.size("spoken") == 0, "no_turns")
        .when(F.col("spoken")[0]["first"] != USER, "starts_without_user")
        .when(seam["last"] != ASSISTANT, "ends_without_reply")
        .when(total("twice") + seam["twice"] > 0, "user_twice")
    )
    running = F.transform("ps", lambda p, i: F.struct(p["part"].alias("part"), F.aggregate(F.slice("ps", 1, i), F.lit(0).cast("long"), lambda acc, q: acc + q["n"]).alias("offset")))
    return Rebuilt(scanned, judged.select("source", "conversation_id", reason.alias("reason"), running.alias("parts")), offsets)
