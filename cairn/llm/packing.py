"""Filling fixed-capacity containers from several sources in given proportions.

Texts wait in source queues.  A container (window) is filled by deficit round-robin: every queue with
texts left earns its quantum, the share of the window that is its target, and the queue furthest
behind delivers its largest text that fits, which may overdraw its deficit; the balance is carried on
across windows.  When no queue with a positive balance fits any more, the remaining room is closed by
the largest waiting text that fits, from whichever queue it overdraws by no more than a window.  So at
any time each source has delivered no more than one window above its target share of all tokens so
far.  Room that no text may close is charged to nobody.

Within a queue texts wait in size classes, so the best fitting text is found without a scan.  A text
above the capacity is cut into full windows and a rest, which wait in its queue and are charged to it
like any other text; nothing else is split.  Special tokens are not added.

Distribution: texts are spread over lanes by a hash, each lane being one task's work of bounded size
(``LANE_TOKENS`` expected tokens), whatever the skew of sources or keys.  A lane fills windows while all
sources with a target last.  What it has left then, and the balance of every source, is carried over
to the lanes of the next round, which are fewer, until one lane is left or a round leaves no fewer;
that last round packs everything, sources that ran out being left out of the shares.

Defined results: null and empty texts have no tokens and no container; rows without an id are left
out; repeated rows are packed as
they come; a null source is a source of its own; sources without a target fill windows of their own
at the end; ties go by document id; an empty table gives none.
"""

from __future__ import annotations

import base64
import bisect
import heapq
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from cairn.durable import Workspace

CAPACITY = 2048
#: Expected tokens of a lane: bounds the work and memory of one task.
LANE_TOKENS = 4_000_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is cut before byte pairs are merged (the pattern published with this vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoder(path: str):
    """The tokenizer whose ranks lie at ``path``; loaded once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, to: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """Add the number of tokens of ``text``; null and empty texts have 0."""

    @F.pandas_udf(IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return df.withColumn(to, count(F.col(text)))


class _Queue:
    """Waiting texts of one source, by size."""

    def __init__(self, share: float, deficit: float) -> None:
        self.share, self.deficit = share, deficit
        self.sizes: list[int] = []
        self.waiting: dict[int, list[tuple]] = {}
        self.left = 0

    def add(self, size: int, item: tuple) -> None:
        if size not in self.waiting:
            bisect.insort(self.sizes, size)
            self.waiting[size] = []
        heapq.heappush(self.waiting[size], item)
        self.left += 1

    def largest(self, room: float) -> int:
        """The largest waiting size of at most ``room``, or 0."""
        i = bisect.bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else 0

    def take(self, size: int) -> tuple:
        item = heapq.heappop(self.waiting[size])
        if not self.waiting[size]:
            del self.waiting[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]
        self.left -= 1
        self.deficit -= size
        return item


class Filled:
    """What :func:`fill` gives: ``rows`` (window, place, id, source, first token, tokens), the texts
    ``left`` over (id, source, first token, tokens) and the ``balance`` of every source."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, str | None, int, int]] = []
        self.left: list[tuple[int, str | None, int, int]] = []
        self.balance: dict[str | None, float] = {}


def fill(items: list[tuple[int, str | None, int, int]], shares: dict[str | None, float], capacity: int = CAPACITY, carry: dict[str | None, float] | None = None, last: bool = True) -> Filled:
    """Pack ``(id, source, first token, tokens)`` in the proportions of ``shares``.

    ``carry`` is the balance brought along.  Unless this is the ``last`` round, filling ends when a
    source with a share has run out.
    """
    out, carry = Filled(), carry or {}
    names = sorted({s for _, s, _, _ in items} | set(shares) | set(carry), key=lambda s: (s is None, s or ""))
    queues = {s: _Queue(shares.get(s, 0.0), carry.get(s, 0.0)) for s in names}
    for key, source, start, n in items:
        end = start + n
        while end - start > capacity:
            queues[source].add(capacity, (key, start))
            start += capacity
        if end > start:
            queues[source].add(end - start, (key, start))
    order, window = list(queues.items()), 0
    while any(q.left for q in queues.values()):
        wanted = [x for x in order if x[1].share > 0]
        if not last and not all(q.left for _, q in wanted):
            break
        live = [x for x in wanted if x[1].left] or [x for x in order if x[1].left]
        weight = sum(q.share for _, q in live)
        portion = {s: q.share / weight if weight else 1 / len(live) for s, q in live}
        room, place = capacity, 0
        for s, q in live:
            q.deficit += capacity * portion[s]

        def put(s: str | None, q: _Queue, size: int) -> None:
            nonlocal room, place
            key, start = q.take(size)
            out.rows.append((window, place, key, s, start, size))
            room -= size
            place += 1

        # the queue furthest behind delivers its largest fitting text, while one is behind at all
        while room:
            behind = [(q.deficit, -k, size) for k, (_, q) in enumerate(live) if q.deficit > 0 and (size := q.largest(room))]
            if not behind:
                break
            _, k, size = max(behind)
            put(*live[-k], size)
        # then the window is closed with the best fits that overdraw no queue by more than a window
        while room:
            fits = [(size, q.deficit, -k) for k, (_, q) in enumerate(live) if (size := q.largest(room if len(live) == 1 else min(room, q.deficit + capacity)))]
            if not fits:
                break
            size, _, k = max(fits)
            put(*live[-k], size)
        for s, q in live:
            q.deficit -= room * portion[s]
        window += 1
    for s, q in order:
        out.balance[s] = q.deficit
        out.left += [(key, s, start, size) for size, waiting in q.waiting.items() for key, start in waiting]
    return out


def proportions(df: DataFrame, source: str, tokens: str) -> dict[str | None, float]:
    """Every source's share of all tokens: one row per source reaches the driver."""
    sums = df.where(F.col(tokens) > 0).groupBy(source).agg(F.sum(tokens)).collect()
    total = sum(n for _, n in sums)
    return {s: n / total for s, n in sums}


def pack(df: DataFrame, key: str, source: str, tokens: str, targets: dict[str | None, float] | None = None, capacity: int = CAPACITY, lane_tokens: int | None = None) -> DataFrame:
    """``(lane, window, place, key, source, start_token, n_tokens)`` of all texts with tokens.

    ``targets`` are token proportions by source; without them, sources keep their own proportions.
    """
    lane_tokens = lane_tokens or LANE_TOKENS
    sized = df.select(F.col(key).cast("long").alias("key"), F.col(source).alias("source"), F.lit(0).alias("start"), F.col(tokens).cast("int").alias("n")).where("n > 0 and key is not null")
    shares = proportions(sized, "source", "n") if targets is None else targets
    if any(x < 0 for x in shares.values()):
        raise ValueError("a share below 0")
    weight = sum(shares.values()) or 1.0
    shares = {s: x / weight for s, x in shares.items()}
    fields = [("lane", IntegerType()), ("window", IntegerType()), ("place", IntegerType()), ("key", LongType()), ("source", StringType()), ("start", IntegerType()), ("n", IntegerType()), ("balance", DoubleType())]
    schema, names = StructType([StructField(n, t) for n, t in fields]), [n for n, _ in fields]

    def packer(first_lane: int, last: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            lane = first_lane + int(group["lane"].iloc[0])
            named = [None if s is None or s != s else s for s in group["source"]]
            texts = group["key"].notna().to_numpy()
            carry: dict[str | None, float] = {}
            for s, balance in ((s, b) for s, b, t in zip(named, group["balance"], texts) if not t):
                carry[s] = carry.get(s, 0.0) + balance
            items = sorted(((int(k), s, int(a), int(n)) for k, s, a, n, t in zip(group["key"], named, group["start"], group["n"], texts) if t), key=lambda x: (x[0], x[2]))
            done = fill(items, shares, capacity, carry, last)
            rows = [(lane, w, p, k, s, a, n, None) for w, p, k, s, a, n in done.rows] + [(lane, None, None, k, s, a, n, None) for k, s, a, n in done.left]
            rows += [] if last else [(lane, None, None, None, s, None, None, b) for s, b in done.balance.items()]
            out = pd.DataFrame(rows, columns=names)
            return out.astype({n: "Int64" for n in ("lane", "window", "place", "key", "start", "n")} | {"balance": "float64"})

        return run

    space, out, base = Workspace(df.sparkSession, "packing"), None, 0
    waiting = sized.withColumn("balance", F.lit(None).cast("double")).withColumn("lane", F.lit(0))
    left, before = sized.agg(F.sum("n")).first()[0] or 0, None
    while True:
        lanes = max(1, -(-left // lane_tokens))
        last = lanes == 1 or lanes == before
        # balances go where their lane's number points, texts anywhere
        lane = F.when(F.col("key").isNull(), F.pmod("lane", F.lit(lanes))).otherwise(F.pmod(F.xxhash64("key", "start"), F.lit(lanes)))
        packed = waiting.withColumn("lane", lane.cast("int")).groupBy("lane").applyInPandas(packer(base, last), schema)
        packed = space.cut(packed, "packed")
        placed = packed.where("window is not null")
        out = placed if out is None else out.unionByName(placed)
        if last:
            break
        waiting = packed.where("window is null").select("lane", "key", "source", "start", "n", "balance")
        base, left, before = base + lanes, waiting.agg(F.sum("n")).first()[0] or 0, lanes
        if not left:
            break
    return out.select("lane", "window", "place", F.col("key").alias(key), F.col("source").alias(source), F.col("start").alias("start_token"), F.col("n").alias("n_tokens"))
