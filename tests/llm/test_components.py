import random

import pytest

from cairn.llm.components import connected_components


def brute(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def run(spark, pairs):
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in pairs], "a string, b string, node string, group_id string")
    return {r.node: r.group_id for r in connected_components(df, "a", "b").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"object-{rng.randrange(10**9)}" for _ in range(120)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(90)]
    pairs += [(b, a) for a, b in pairs[:20]] + pairs[:10] + [(None, "n1"), ("n2", None), ("s", "s"), (None, None)]
    assert run(spark, pairs) == brute(pairs)


def test_sorted_chain_and_hub(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    hub = [("zz-hub", f"h{i:03d}") for i in range(200)]
    assert run(spark, chain + hub) == brute(chain + hub)


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", "a"), (None, "b")]) == {}
