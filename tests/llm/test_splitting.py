import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm.splitting import split, split_table


def check(text, limit, overlap):
    pieces = split(text, limit, overlap)
    at = 0
    for k, (s, e) in enumerate(pieces):
        assert s < e and len(text[s:e].encode("utf-8", "surrogatepass")) <= limit
        if k:
            assert s < at and s > pieces[k - 1][0], "shares a character at least, and moves on"
            assert len(text[s:at].encode("utf-8", "surrogatepass")) <= max(overlap, 4)
        assert e > at
        at = e
    if text:
        assert pieces[0][0] == 0 and at == len(text)
        rebuilt, at = "", 0
        for s, e in pieces:
            rebuilt += text[at:e]
            at = e
        assert rebuilt == text
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n#-。我é😀", max_size=400), st.integers(20, 90), st.integers(1, 10))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_boundaries():
    text = "\n\n".join(f"Paragraph {i} has some words. It also has a second sentence." for i in range(40))
    pieces = check(text, 500, 60)
    assert all(text[s:e].endswith(("\n\n", ".")) for s, e in pieces)


@pytest.mark.parametrize("text", ["a" * 10_000, "我" * 5_000, "😀" * 3_000, "word " * 3_000, "x" * 3_999, "y" * 4_000, "z" * 4_001])
def test_long_runs(text):
    pieces = check(text, 4_000, 200)
    assert (len(pieces) > 1) == (len(text.encode()) > 4_000)


def test_table(spark):
    df = spark.createDataFrame([("a", "x" * 4001, 1), ("a", "x" * 4001, 1), ("b", None, 2), ("c", "", 3), ("d", "é" * 2001, 4)], "id string, text string, piece int")
    out = split_table(df, ["id"], "text").collect()
    assert sorted({r.id for r in out}) == ["a", "d"] and sum(r.id == "a" for r in out) == 4
    assert split_table(df.limit(0), ["id"], "text").count() == 0
    with pytest.raises(ValueError):
        split("x", 100, 95)
