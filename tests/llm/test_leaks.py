import random

import pytest

from cairn.llm import leaks as module
from cairn.llm.leaks import Scanner, joined_words, leaks, passages
from cairn.llm.shingles import WORD

RNG = random.Random(5)
WORDS = [f"{a}{b}" for a in "ka lo mi nu re so ta vi".split() for b in "ber dan fel gor hin jus".split()]
HEAD = "Answer in one short paragraph and do not guess."


def passage(n):
    return [RNG.choice(WORDS) for _ in range(n)]


P = [passage(60), passage(48), passage(15), passage(30)]
ITEMS = [(1, HEAD + "\n\n" + " ".join(P[0])), (2, HEAD + "\n\n" + " ".join(P[1]).capitalize()), (3, " ".join(P[2])), (4, " ".join(P[3])), (5, " ".join(P[3])), (6, None), (7, "")]


PASSAGES = [(i, t.split("\n\n")[-1] if t else t) for i, t in ITEMS]


def noise(n):
    return " ".join("x" + RNG.choice(WORDS) for _ in range(n))


def found(text):
    return {leak[0] for leak in Scanner(PASSAGES).scan(text)}


def test_whole_partial_and_changed():
    changed = [w if i % 11 != 5 else "other" for i, w in enumerate(P[0])]
    dropped = P[0][:20] + P[0][21:45]
    assert found(noise(30) + " " + " ".join(P[0]) + " " + noise(30)) == {1}
    assert found(noise(9) + ",\n" + ",\n".join(P[1][10:32]).upper() + "! " + noise(9)) == {2}
    assert found(" ".join(changed)) == {1}
    assert found(" ".join(dropped)) == {1}
    assert found(" ".join(P[2])) == {3}
    assert found(" ".join(P[3])) == {4, 5}


def test_too_short_or_only_the_instruction():
    assert found(" ".join(P[0][:18])) == set()
    assert found(HEAD + " " + noise(50)) == set()
    assert found(" ".join(P[0][:12] + passage(20) + P[0][40:52])) == set()
    assert found("") == set() and found(None) == set() and found("   ") == set()


def test_an_exact_run_counts_whatever_follows():
    rest = [w if i % 7 > 1 else "other" for i, w in enumerate(P[0][22:])]
    text = noise(9) + " " + " ".join(P[0][:22] + rest)
    assert found(text) == {1}
    ((_, n, a, b),) = Scanner(PASSAGES).scan(text)
    assert n >= 22 and text[a:b].split()[:22] == P[0][:22]
    assert found(" ".join(P[0][:20] + ["other" if i % 7 < 4 else w for i, w in enumerate(P[0][20:])])) == set()


def test_offsets():
    text = "Start. " + " ".join(P[0][5:40]).title() + ". End"
    ((item, n, a, b),) = Scanner(PASSAGES).scan(text)
    assert (item, n) == (1, 35) and text[a:b].lower().split() == P[0][5:40]


def test_offsets_where_lower_case_is_longer():
    text = "\u0130\u0130 start \u0130. " + " ".join(P[0][5:40]).title() + ". \u0130"
    ((item, n, a, b),) = Scanner(PASSAGES).scan(text)
    assert (item, n) == (1, 35) and text[a:b].lower().split() == P[0][5:40]


@pytest.mark.parametrize("text", ["", "One_two  three-4", "d\u00e9j\u00e0 \u201cvu\u201d \u2014 na\u00efve", "e\u0301te\u0301 co\u0301mo", "\u6771\u4eac\u3067\u3059 abc", "\u0939\u093f\u0928\u094d\u0926\u0940 text", "\u041f\u0440\u0438\u0432\u0435\u0442, \u043c\u0438\u0440 \u00b2\u00bd \u216b", "\u0e44\u0e17\u0e22 x"])
def test_quick_words_equal_the_rule(text):
    assert joined_words(text.lower()) == " ".join(WORD.findall(text.lower()))


def test_passages_lose_shared_heads_only(spark):
    rows = [*ITEMS, (8, "Own head.\n\nbody"), (9, "  " + HEAD + " \n\n\n next")]
    got = {r.item_id: r.passage for r in passages(spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert got[1] == " ".join(P[0]) and got[8] == "Own head.\n\nbody" and got[9].strip() == "next" and 6 not in got and 7 not in got


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, noise(5) + " " + " ".join(p)) for i, p in enumerate(P)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted(map(tuple, leaks(docs, items, "doc_id", "text").collect()))
    monkeypatch.setattr(module, "BLOCK", 200)
    assert len(whole) == 5 and sorted(map(tuple, leaks(docs, items, "doc_id", "text").collect())) == whole


def test_table(spark):
    docs = spark.createDataFrame([(1, " ".join(P[0]), 0), (2, None, 0), (3, "", 0), (1, " ".join(P[0]), 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leaks(docs, items, "doc_id", "text").collect()] == [(1, 1), (1, 1)]
    assert leaks(docs, items.limit(0), "doc_id", "text").count() == 0
    assert leaks(docs.limit(0), items, "doc_id", "text").count() == 0
