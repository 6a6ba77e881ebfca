from cairn.llm.conversations import estimate_shift, rebuild

SCHEMA = "source string, conversation_id string, message_id string, sender string, t long, pos long, text string"


def judge(spark, messages, records=("a", "b"), mentioned=(), **kw):
    rows = [("s", c, m, sender, t, i, "x") for i, (c, m, sender, t) in enumerate(messages)]
    names = spark.createDataFrame([("s", c) for c in records], "source string, conversation_id string")
    more = spark.createDataFrame([("s", c) for c in mentioned], "source string, conversation_id string")
    return rebuild(spark.createDataFrame(rows, SCHEMA), names, more, **kw)


def reasons(*args, **kw):
    return {r.conversation_id: r.reason for r in judge(*args, **kw).rejected().collect()}


def test_reasons(spark):
    good = [("a", "1", "Human", 10), ("a", "2", "ASSISTANT", 20), ("a", "2", "assistant", 20), ("a", "s", "system", 1), ("a", "3", "assistant", 25), ("a", "4", "user", 30), ("a", "5", "assistant", 40), ("a", "t", "tool", 50)]
    assert reasons(spark, good) == {"b": "empty"}
    cases = {
        "user_twice": [("c", "1", "user", 1), ("c", "2", "user", 2), ("c", "3", "assistant", 3)],
        "ends_without_reply": [("c", "1", "user", 1), ("c", "2", "assistant", 2), ("c", "3", "user", 3)],
        "starts_without_user": [("c", "1", "assistant", 1), ("c", "2", "user", 2), ("c", "3", "assistant", 3)],
        "no_turns": [("c", "1", "system", 1)],
        "malformed": [("c", "1", "user", 1), ("c", "2", "bot", 2), ("c", "3", "assistant", 3)],
    }
    for reason, rows in cases.items():
        assert reasons(spark, rows, ["c"]) == {"c": reason}
    assert reasons(spark, [("c", "1", "user", None), ("c", "2", "assistant", 2)], ["c"]) == {"c": "malformed"}
    assert reasons(spark, [("x", "1", "user", 1), ("x", "2", "assistant", 2)], ["c"]) == {"x": "orphaned", "c": "empty"}
    assert reasons(spark, good, ["a"], ["a", "m"]) == {"m": "orphaned"}
    assert reasons(spark, [(None, "1", "user", 1)], []) == {}


def test_turns_across_partitions(spark):
    many = [("a", str(i), "user" if i % 2 == 0 else "assistant", 1000 + i) for i in range(400)]
    many += [("b", str(i), "user", 10 + 10 * i) for i in range(3)] + [("b", f"r{i}", "assistant", 15 + 10 * i) for i in range(3)]
    result = judge(spark, many[::-1])
    assert result.rejected().count() == 0
    turns = {c: [] for c in "ab"}
    for r in result.turns().orderBy("conversation_id", "turn_no").collect():
        turns[r.conversation_id].append((r.turn_no, r.role))
    assert turns["a"] == [(i, "user" if i % 2 == 0 else "assistant") for i in range(400)]
    assert [r for _, r in turns["b"]] == ["user", "assistant"] * 3
    broken = many[:200] + [("a", "extra", "user", 1199)] + many[200:400]
    assert reasons(spark, broken, ["a"]) == {"a": "user_twice"}


def test_clock_shift(spark):
    assert estimate_shift([10, 100], [20, 110]) == 0
    assert estimate_shift([10, 100], [5, 95]) == 6
    assert estimate_shift([10, 100], [120, 210]) == -21
    assert estimate_shift([10, 11], [300, 20]) is None
    assert estimate_shift([], []) is None


def test_offset_of_a_skewed_clock(spark):
    """Assistants' clocks lag by 30 s; the fit recovers what the order needs, broken ones stay broken."""
    import random

    rng = random.Random(4)
    lag, messages, good, broken = 30_000_000, [], [], []
    for c in range(120):
        name, t = f"c{c}", rng.randrange(10**9)
        roles = ["user", "assistant"] * rng.randint(1, 6)
        if c % 10 == 0:
            roles = [*roles, "user"]
        elif c % 10 == 1:
            roles = ["assistant", "user", *roles[1:]]
        (broken if c % 10 < 2 else good).append(name)
        for i, role in enumerate(roles):
            t += rng.randint(1_000_000, 90_000_000)
            messages.append((name, f"m{i}", role, t - (lag if role == "assistant" else 0)))
    rng.shuffle(messages)
    names = good + broken
    result = judge(spark, messages, names)
    assert lag - 3_000_000 <= result.offsets["s"] <= lag
    assert {r.conversation_id for r in result.rejected().collect()} == set(broken)
    as_recorded = {r.conversation_id for r in judge(spark, messages, names, offsets={}).rejected().collect()}
    assert set(broken) - as_recorded == set() and len(as_recorded) > len(broken) + 20
    for r in result.turns().where("turn_no % 2 = 0").collect():
        assert r.role == "user"


def test_no_offset_where_clocks_agree(spark):
    rows = [(f"c{c}", f"{i}", "user" if (i + (c % 9 == 0)) % 2 == 0 else "assistant", 1000 * c + 10 * i) for c in range(60) for i in range(4)]
    result = judge(spark, rows, [f"c{c}" for c in range(60)])
    assert result.offsets == {"s": 0}
    assert {r.conversation_id for r in result.rejected().collect()} == {f"c{c}" for c in range(0, 60, 9)}


def test_least_squares_where_intervals_conflict(spark):
    from cairn.llm.conversations import estimate_offsets

    rows = [("s", low, high) for low, high in ((10, 20), (14, 20), (18, 20), (26, 40), (30, 40), (900, 910))] + [("t", -5, 7)]
    got = estimate_offsets(spark.createDataFrame(rows, "source string, low long, high long"))
    assert got == {"s": 23, "t": 0}  # 3 (d - 20) = (26 - d) + (30 - d); one asks for far more than the rest
    assert estimate_offsets(spark.createDataFrame([], "source string, low long, high long")) == {}
