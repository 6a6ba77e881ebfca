import math
import random

import pytest

from cairn.llm.packing import TOKENIZER, count_tokens, encoder, fill, pack

CAPACITY = 1000


def check(items, rows, capacity):
    """Every item is placed once, whole unless above the capacity; returns window -> sizes."""
    windows, pieces = {}, {}
    for window, _, key, _, start, n in rows:
        windows.setdefault(window, []).append(n)
        pieces.setdefault(key, []).append((start, n))
    assert all(sum(w) <= capacity for w in windows.values())
    for key, _, _, n in items:
        if n:
            own = sorted(pieces[key])
            assert own[0][0] == 0 and sum(x for _, x in own) == n
            assert all(a + x == b for (a, x), (b, _) in zip(own, own[1:]))
            assert len(own) == 1 or n > capacity
    return windows


def drift(rows, shares, capacity, until):
    """The largest distance of any source's running total from its target, in windows."""
    total, own, worst, window = 0, dict.fromkeys(shares, 0), 0, 0
    for w, _, _, s, _, n in rows:
        if w != window:
            worst, window = max(worst, max(abs(own[x] - shares[x] * total) for x in shares)), w
        if w >= until:
            break
        total, own[s] = total + n, own[s] + n
    return worst / capacity


def pool(seed, sources, n=3000, oversized=()):
    rng = random.Random(seed)
    items = [(i, rng.choice(sources), 0, min(CAPACITY, max(1, int(rng.lognormvariate(4.5, 1.2))))) for i in range(n)]
    return items + [(n + i, s, 0, size) for i, (s, size) in enumerate(oversized)]


@pytest.mark.parametrize("shares", [{"a": 0.8, "b": 0.2}, {"a": 0.5, "b": 0.5}, {"a": 0.1, "b": 0.9}, {"a": 0.2, "b": 0.3, None: 0.5}])
@pytest.mark.parametrize("oversized", [(), [("a", 20_480)], [("b", 10_001), ("a", 4_000)]])
def test_targets_unlike_the_pool(shares, oversized):
    items = pool(3, list(shares), oversized=oversized)
    mixed = fill(items, shares, CAPACITY, last=False)  # ends when a source runs out
    until = 1 + max(r[0] for r in mixed.rows)
    assert until > 50 and mixed.left
    assert drift(mixed.rows, shares, CAPACITY, until) <= 1.0 * (len(shares) - 1)
    full = [0] * until
    for r in mixed.rows:
        full[r[0]] += r[5]
    assert sum(full) >= 0.99 * CAPACITY * until
    done = fill(items, shares, CAPACITY)
    windows = check(items, done.rows, CAPACITY)
    assert not done.left and [r for r in done.rows if r[0] < until] == mixed.rows
    assert len(windows) <= math.ceil(sum(i[3] for i in items) / CAPACITY) * 1.02 + 2


def test_every_window_is_mixed_when_texts_are_small():
    rng = random.Random(1)
    items = [(i, rng.choice("ab"), 0, rng.randint(5, 40)) for i in range(6000)]
    shares = {"a": 0.8, "b": 0.2}
    done = fill(items, shares, CAPACITY, last=False)
    per = {}
    for w, _, _, s, _, n in done.rows:
        per.setdefault(w, {"a": 0, "b": 0})[s] += n
    assert len(per) > 40
    per.pop(max(per))  # here a source ran out
    for own in per.values():
        assert abs(own["a"] - 0.8 * sum(own.values())) <= 80  # a text or two


def test_oversized_texts_are_charged():
    items = [(0, "a", 0, 20_480)] + [(i, "b", 0, 512) for i in range(1, 60)]
    rows = fill(items, {"a": 0.5, "b": 0.5}, 2048).rows
    first = {}
    for w, _, _, s, _, _ in rows:
        first.setdefault(w, set()).add(s)
    assert [first[w] for w in range(6)] in ([{"a"}, {"b"}] * 3, [{"b"}, {"a"}] * 3)


def test_balances_are_carried_over():
    items = pool(5, ["a", "b"], 400)
    shares = {"a": 0.5, "b": 0.5}
    rows = fill(items, shares, CAPACITY, {"a": 5000.0, "b": -5000.0}).rows
    early = [r for r in rows if r[0] < 8]
    assert sum(r[5] for r in early if r[3] == "a") > 0.8 * sum(r[5] for r in early)
    mixed = fill(items, shares, CAPACITY, last=False)
    assert abs(sum(mixed.balance.values())) < 1e-6


def test_small_cases():
    assert fill([], {}).rows == []
    items = [(1, "a", 0, 2048), (2, "a", 0, 1), (3, "b", 0, 2047)]
    check(items, fill(items, {"a": 0.5, "b": 0.5}, 2048).rows, 2048)
    only = fill([(1, "x", 0, 10), (2, "y", 0, 10)], {"z": 1.0}, 100).rows
    assert len(only) == 2  # sources without a target still get windows


def test_tables(spark):
    rows = [(i, s, t) for i, (s, t) in enumerate([("x", "one two three"), ("x", ""), (None, None), ("y", "hello " * 5000), (None, "tail"), ("x", "one two three")])]
    df = count_tokens(spark.createDataFrame(rows, "doc_id long, source string, text string"), "text")
    counted = {r.doc_id: r.n_tokens for r in df.collect()}
    assert counted[1] == 0 and counted[2] == 0 and counted[0] == len(encoder(TOKENIZER).encode_ordinary("one two three"))
    for targets in (None, {"x": 0.5, "y": 0.5}):
        out = pack(df, "doc_id", "source", "n_tokens", targets).collect()
        check([(r[0], r[1], 0, counted[r[0]]) for r in rows if counted[r[0]]], [((r.lane, r.window), r.place, r.doc_id, r.source, r.start_token, r.n_tokens) for r in out], 2048)
    assert pack(df.limit(0), "doc_id", "source", "n_tokens").count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", "source", "n_tokens", {"x": -1.0})


def test_lanes_carry_over(spark):
    items = pool(7, ["a", "b", "b"], 4000, oversized=[("a", 9_500)])
    shares = {"a": 0.5, "b": 0.5}
    df = spark.createDataFrame([(k, s, n, "extra") for k, s, _, n in items], "doc_id long, source string, n_tokens int, key string")
    out = pack(df, "doc_id", "source", "n_tokens", shares, CAPACITY, lane_tokens=60_000).collect()
    windows = check(items, [((r.lane, r.window), r.place, r.doc_id, r.source, r.start_token, r.n_tokens) for r in out], CAPACITY)
    total = sum(i[3] for i in items)
    assert len({r.lane for r in out}) > 4 and total / CAPACITY / len(windows) > 0.98
    first = -(-total // 60_000)
    for lane in range(first):
        own = sorted((r.window, r.place, r.doc_id, r.source, r.start_token, r.n_tokens) for r in out if r.lane == lane)
        assert drift(own, shares, CAPACITY, 1 + own[-1][0]) <= 1.0
