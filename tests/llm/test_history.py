import numpy as np
import pytest

from cairn.durable import Workspace
from cairn.llm import history
from cairn.llm.shingles import TokenBatch

WORDS = "amber basil cedar delta ember fjord grove heron inlet jetty kayak larch maple north ochre pearl quilt raven slate tulip umber viola wheat xenon yacht zebra".split()
SCHEMA = "record_id long, batch_no int, owner long, updated long, texts array<string>, a long, token string"


def text(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(40)) for i in rng.integers(0, len(WORDS), n))


def change(t, every, at=3, word="changed"):
    return " ".join(word if i % every == at else w for i, w in enumerate(t.split()))


def tokens(texts, size):
    found = TokenBatch(texts or [], np.zeros(len(texts or []), dtype=int), size)
    return set(found.token.tolist()), set(found.message.tolist())


def jaccard(x, y):
    return len(x & y) / len(x | y)


def brute(rows):
    accepted, out = {}, {}
    for rid, _, owner, updated, texts, *_ in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        (wide, messages), (fine, _) = tokens(texts, history.SIZE), tokens(texts, history.FINE)
        if not wide:
            continue
        best = None
        for a, (w, f, own, o, u) in accepted.items():
            longer = o == owner and u is not None and updated is not None and updated > u and own < messages
            s = jaccard(fine, f)
            alike = jaccard(wide, w) >= history.CANDIDATE and min(len(wide), len(w)) >= history.RATIO * max(len(wide), len(w))
            if alike and s >= history.THRESHOLD and not longer and (best is None or (s, -a) > best):
                best = (s, -a)
        if best:
            out[rid] = -best[1]
        else:
            accepted[rid] = (wide, fine, messages, owner, updated)
    return out


@pytest.fixture(scope="module")
def rows():
    base = [text(i) for i in range(30)]
    out = [(i, i // 10, i, 100, [t, text(1000 + i, 60)], 1, "x") for i, t in enumerate(base)]
    n = len(out)

    def add(texts, owner=None, updated=200):
        nonlocal n
        out.append((n, 3 + (n - 30) // 25, owner if owner is not None else n, updated, texts, None, None))
        n += 1

    for i in range(6):
        add([base[i], text(1000 + i, 60)])  # the same
        add([text(1000 + i, 60).upper(), base[i].replace(" ", ",  ")])  # order, case, punctuation
        add([change(base[i], 25), text(1000 + i, 60)])  # a few words
        add([base[i], text(5000 + i, 200)])  # shares a message only
        add([base[i], text(1000 + i, 60), text(7000 + i, 20)], owner=i, updated=300)  # a longer version
        add([change(base[i], 25), text(1000 + i, 60)])  # repeats a rejected row
    add(None)
    add([])
    add([None, "", "  ", "..."])
    add(["two words"])
    add(["Two  words!"])
    add([base[20], None], updated=None)
    return out


def pairs(df):
    found = df.collect()
    out = {r.record_id_b: r.record_id_a for r in found}
    assert len(out) == len(found)
    return out


def test_against_brute_force(spark, rows):
    expected = brute(rows)
    assert len(expected) >= 20
    assert pairs(history.deduplicate(spark.createDataFrame(rows, SCHEMA))) == expected


def test_one_large_batch_and_null_batches(spark, rows):
    for number in (7, None):
        whole = [(r[0], number, *r[2:]) for r in rows]
        assert pairs(history.deduplicate(spark.createDataFrame(whole, SCHEMA))) == brute(whole)


def test_reopened_history_equals_one_session(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    where = Workspace(spark, "reopened").location("history")
    numbers = sorted({r[1] for r in rows})
    first = history.History.create(spark, where, 3)
    got = {}
    for no in numbers[:3]:
        got |= pairs(first.accept(df.where(df.batch_no == no)))
    first.close()
    again = history.History.open(spark.newSession(), where)
    # a batch that fails on its way leaves postings behind, which must not count
    append = again._append

    def lost(name, frame, by, *codec):
        append(name, frame, by, *codec)
        if by == "record_id":
            raise RuntimeError("lost")

    again._append = lost
    with pytest.raises(RuntimeError):
        again.accept(df.where(df.batch_no == numbers[3]))
    last = history.History.open(spark, where)
    for no in numbers[3:]:
        got |= pairs(last.accept(df.where(df.batch_no == no)))
    assert got == brute(rows)
    with pytest.raises(FileNotFoundError):
        history.History.open(spark, where + "-absent")


def test_a_family_new_in_a_batch_stays_linear(spark, monkeypatch):
    """Near-copies of one unseen text meet their leaders, not one another."""
    m = 1200
    base = text(1, 200).split()
    rng = np.random.default_rng(5)

    def copy(i):
        words = list(base)
        for at in rng.choice(200, 3, replace=False):
            words[at] = f"edit{i}x{at}"
        return " ".join(words)

    rows = [(i, 0, i, 0, [text(9000 + i, 80)], 0, "") for i in range(40)] + [(100 + i, 1, 100 + i, 0, [copy(i)], 0, "") for i in range(m)]
    met = []
    meeting = history.History._meeting

    def counted(self, *args):
        out = meeting(self, *args)
        met.append(out.count())
        return out

    monkeypatch.setattr(history.History, "_meeting", counted)
    got = pairs(history.deduplicate(spark.createDataFrame(rows, SCHEMA)))
    assert set(got) == set(range(101, 100 + m)) and set(got.values()) == {100}
    assert sum(met) < 12 * m


def test_chained_family_with_leaders(spark, monkeypatch):
    """Families that drift: every list is hot, and verdicts depend on earlier rows."""
    monkeypatch.setattr(history, "HOT", 3)
    rows, words = [], text(3, 150).split()
    for i in range(60):
        words[(i * 7) % 150] = f"drift{i}"
        rows.append((i, i % 2 if i > 40 else 0, i, 0, [" ".join(words)], 0, ""))
    rows += [(100 + i, 1, 0, 0, [text(50 + i % 5, 90)], 0, "") for i in range(20)]
    assert pairs(history.deduplicate(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_boilerplate_that_appears_later_renews_the_order(spark, monkeypatch):
    """Text that a third of a later batch opens with is no match, and is not searched by for long."""
    monkeypatch.setattr(history, "HOT", 8)
    opening = text(77, 40)
    rows = [(i, 0, i, 0, [text(200 + i, 60)], 0, "") for i in range(20)]
    rows += [(100 + i, 1 + i // 40, 100 + i, 0, [f"{opening} {text(400 + i % 70, 60)}"], 0, "") for i in range(80)]
    renewed = []
    renew = history.History._renew
    monkeypatch.setattr(history.History, "_renew", lambda self, reps: (renewed.append(1), renew(self, reps)))
    assert pairs(history.deduplicate(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert renewed


def test_copies_of_one_text(spark):
    same = text(1)
    rows = [(i, i % 3, i, i, [same], 0, "") for i in range(200)]
    got = pairs(history.deduplicate(spark.createDataFrame(rows, SCHEMA)))
    assert set(got.values()) == {0} and len(got) == 199


def test_empty(spark):
    assert history.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
    none = [(1, 0, 1, 1, None, 0, ""), (2, 1, 1, 1, ["..."], 0, ""), (None, 1, 1, 1, ["some words"], 0, "")]
    assert history.deduplicate(spark.createDataFrame(none, SCHEMA)).count() == 0
