"""Evaluation passages inside a training corpus, by one Aho-Corasick automaton.

All runs of :data:`RUN` words of the normalised passages go into one automaton.  A text is normalised
(lower case, words only, single spaces) and scanned once; each hit names the passages and places it
belongs to.  Hits of one passage that stay on a diagonal form a chain, over changed, missing or
added words; the ends of a chain are extended word by word.  A chain counts when it covers
:data:`LEAST` words of the passage, or the whole of a shorter one, and all but a few are unchanged; of a chain with more changes its longest
part that is so counts.  Only texts with hits are looked at word by word; their words keep their
offsets, also where lower case is longer than the text, so spans refer to the original.

An instruction line, set off by a blank line and shared by several items, is not part of a passage.

The evaluation set is taken in blocks of :data:`BLOCK` characters, each one automaton: one block for
sets of usual size, and one scan of the corpus for each block beyond, so what is shipped to the tasks
is bounded.  The corpus is scanned in place, without a shuffle.

Defined results: null and empty texts and items have no hits; items with the same passage are all
reported; a passage that occurs twice in a text is one leak (the longest span); extra columns are
ignored; very long texts take time in proportion to their length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from difflib import SequenceMatcher

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField

from cairn.llm.arrow import explode_texts
from cairn.llm.shingles import WORD

RUN = 5
LEAST = 22
#: Characters of passages in one automaton.
BLOCK = 16_000_000
#: A chain may drift by so many words (missing or added ones) and skip so many between two hits.
DRIFT, SKIP = 3, 12
#: Extension at the ends: score of a matching and of a changed word.
MATCH, CHANGE = 1.0, -1.5
#: How far the score may fall between two hits or beyond the last one.
DROP = -4.0
#: Words looked at beyond a stretch of hits, before its item is looked at closely.
AHEAD = 8


#: The share of a span's words that must be unchanged.
KEPT = 0.85


def _best_part(passage: list[str], words: list[str], need: int) -> tuple[int, int, int] | None:
    """The longest part of a passage's span that stands in the text with all but a few words unchanged.

    ``(words covered, first, end)`` with places in ``words``; the whole span where it will do, and
    nothing where no part covers ``need`` words.
    """
    kept = [(m.a + k, m.b + k) for m in SequenceMatcher(None, passage, words, autojunk=False).get_matching_blocks() for k in range(m.size)]
    if len(passage) >= need and len(kept) >= KEPT * len(passage):
        return len(passage), 0, len(words)
    best = None
    for first, (i0, j0) in enumerate(kept):
        for last in range(len(kept) - 1, first - 1, -1):
            covered = kept[last][0] + 1 - i0
            if covered < need or (best and covered <= best[0]):
                break
            if last + 1 - first >= KEPT * covered:
                best = covered, j0, kept[last][1] + 1
                break
    return best


def _longest_run(hits: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """``(words covered, first, end)`` of the longest stretch of hits that follow each other word by word."""
    best, running = (0, 0, 0), {}
    for j, i, n in hits:
        first, last = running.get(j - i, (j, j - 1))
        if last != j - 1:
            first = j
        running[j - i] = first, j
        best = max(best, (j + n - first, first, j + n), key=lambda r: r[0])
    return best


def passages(items: DataFrame) -> DataFrame:
    """``(item_id, passage)``: items without an instruction line that several share; null and blank items have none."""
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    split = items.select("item_id", text.alias("text")).where("text <> ''").withColumn("_head", F.when(F.contains("text", F.lit("\n\n")), F.substring_index("text", "\n\n", 1)))
    head = F.regexp_replace("_head", r"(?U)^\s+|\s+$", "")
    shared = split.where("_head is not null").groupBy(head.alias("_shared")).agg(F.count("*").alias("_n")).where("_n > 1")
    joined = split.join(shared, head == F.col("_shared"), "left")
    return joined.select("item_id", F.when(F.col("_n") > 1, F.expr("substring(text, length(_head) + 3)")).otherwise(F.col("text")).alias("passage"))


#: Texts of characters that are letters or digits by themselves or no part of a word, as far as these are concerned.
_PLAIN = re.compile(r"[\x00-\u02ff\u0370-\u0482\u048a-\u0590\u2000-\u20cf\u2100-\u2bff]*")
_PLAIN_WORD = re.compile(r"[^\W_]+")
_ASCII = {i: " " for i in range(128) if not chr(i).isalnum()}


def joined_words(low: str) -> str:
    """The words of a text in lower case, single spaces between them."""
    if low.isascii():
        return " ".join(low.translate(_ASCII).split())
    return " ".join((_PLAIN_WORD if _PLAIN.fullmatch(low) else WORD).findall(low))


def _places(text: str, low: str) -> np.ndarray | None:
    """Where each character of the lower-case text stands in the original; None where nothing moves."""
    if len(low) == len(text):
        return None
    return np.append(np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]), len(text))


class Scanner:
    """The automaton of a set of passages ``(item, passage)``."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.words = {item: joined_words((text or "").lower()).split() for item, text in items}
        runs: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, words in self.words.items():
            n = min(RUN, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                runs[f" {' '.join(words[i : i + n])} "].append((item, i))
        self._automaton = ahocorasick.Automaton()
        for number, run in enumerate(runs):
            self._automaton.add_word(run, number)
        self._empty = not runs
        if self._empty:
            return
        self._automaton.make_automaton()
        # the places of every run, and the passages as numbers, side by side
        self._items = list(self.words)
        index = {item: k for k, item in enumerate(self._items)}
        self._length = np.array([run.count(" ") - 1 for run in runs])
        self._many = np.array([len(places) for places in runs.values()])
        self._from = np.cumsum(self._many) - self._many
        self._item = np.array([index[item] for places in runs.values() for item, _ in places])
        self._at = np.array([i for places in runs.values() for _, i in places])
        self._vocabulary = {w: k for k, w in enumerate(sorted({w for words in self.words.values() for w in words}))}
        gap = [-1] * AHEAD
        flat = list(gap)
        starts = []
        for words in self.words.values():
            starts.append(len(flat))
            flat += [self._vocabulary[w] for w in words] + gap
        self._flat, self._starts = np.array(flat), np.array(starts)
        self._need = np.array([min(LEAST, len(words)) for words in self.words.values()])

    def _promising(self, words: list[str], item: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The items whose hits may make a leak.

        Hits that follow each other word by word are one stretch.  A stretch alone near its diagonal,
        shorter than needed, and whose ends cannot be extended, is none: most chance hits are such.
        """
        diagonal = j - i
        order = np.lexsort((j, diagonal, item))
        item, diagonal, j, n = item[order], diagonal[order], j[order], n[order]
        same = (item[1:] == item[:-1]) & (diagonal[1:] == diagonal[:-1]) & (j[1:] == j[:-1] + 1)
        first = np.flatnonzero(np.r_[True, ~same])
        hits = np.diff(np.r_[first, len(item)])
        item, diagonal, j, length = item[first], diagonal[first], j[first], hits - 1 + n[first]
        beside = (item[1:] == item[:-1]) & (diagonal[1:] - diagonal[:-1] <= DRIFT)
        good = (length >= self._need[item]) | np.r_[False, beside] | np.r_[beside, False]
        text = np.full(len(words) + 2 * AHEAD, -2)
        text[AHEAD : AHEAD + len(words)] = [self._vocabulary.get(w, -3) for w in words]
        here, there = j + AHEAD, self._starts[item] + j - diagonal
        steps = np.arange(AHEAD)
        for a, b, sign in ((here + length, there + length, 1), (here - 1, there - 1, -1)):
            match = text[a[:, None] + sign * steps] == self._flat[b[:, None] + sign * steps]
            score = np.cumsum(np.where(match, MATCH, CHANGE), axis=1)
            good |= (score > 0).any(axis=1) | (score[:, -1] > DROP)
        return np.unique(item[good])

    def _extend(self, words: list[str], passage: list[str], i: int, j: int, step: int) -> int:
        """How many words of the passage follow from (i, j) in a direction, changed ones included."""
        score = best = 0.0
        length = n = 0
        while 0 <= i < len(passage) and 0 <= j < len(words) and score > best + DROP:
            n += 1
            score += MATCH if passage[i] == words[j] else CHANGE
            if score > best:
                best, length = score, n
            i, j = i + step, j + step
        return length

    def _between(self, words: list[str], passage: list[str], chain: list[int], i: int, j: int) -> float:
        """The score of what lies between a chain's end and its next hit."""
        gap, other = i - chain[1], j - chain[3]
        if gap < 0 or other < 0:  # overlapping hits; drift is a missing or added word
            return CHANGE * abs(gap - other)
        if gap == other:
            return sum(MATCH if passage[chain[1] + k] == words[chain[3] + k] else CHANGE for k in range(gap))
        return CHANGE * max(gap, other)

    def _chains(self, words: list[str], passage: list[str], hits: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """Chains of hits ``(j, i, n)`` in text order: first i, last end in the passage, first j, last j."""
        open_: list[list[int]] = []  # first i, end i, first j, end j, diagonal
        for j, i, n in hits:
            for chain in reversed(open_):
                if abs((j - i) - chain[4]) <= DRIFT and i + n > chain[1] and j + n > chain[3] and j - chain[3] <= SKIP and self._between(words, passage, chain, i, j) > DROP:
                    chain[1], chain[3], chain[4] = i + n, j + n, j - i
                    break
            else:
                open_.append([i, i + n, j, j + n, j - i])
        for c in open_:
            yield c[0], c[1], c[2], c[3]

    def scan(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``(item, words of the passage, start, end)`` of every leak in a text; end is exclusive."""
        if not text or self._empty:
            return []
        low = text.lower()
        line = f" {joined_words(low)} "
        raw = list(self._automaton.iter(line))
        if not raw:
            return []
        words = line.split()
        at = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)  # where each word's leading space is
        found = np.array(raw)
        number = found[:, 1]
        many = self._many[number]
        place = np.repeat(self._from[number] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        n = np.repeat(self._length[number], many)
        item, i, j = self._item[place], self._at[place], np.repeat(np.searchsorted(at, found[:, 0]), many) - n
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for k in self._promising(words, item, i, j, n):
            own = item == k
            hits[self._items[k]] = list(zip(j[own].tolist(), i[own].tolist(), n[own].tolist()))
        out = []
        spans = None
        for item, own in hits.items():
            passage = self.words[item]
            need = min(LEAST, len(passage))
            run = _longest_run(own)
            best = run if run[0] >= need else None
            for i0, i1, j0, j1 in self._chains(words, passage, own):
                if i1 - i0 < RUN + 1 and need > i1 - i0:
                    continue  # a single run that nothing continues
                back = self._extend(words, passage, i0 - 1, j0 - 1, -1)
                forth = self._extend(words, passage, i1, j1, 1)
                covered = (i1 + forth) - (i0 - back)
                if covered >= need and (best is None or covered > best[0]):
                    part = _best_part(passage[i0 - back : i1 + forth], words[j0 - back : j1 + forth], need)
                    if part and (best is None or part[0] > best[0]):
                        best = (part[0], j0 - back + part[1], j0 - back + part[2])
            if best:
                if spans is None:
                    spans, places = [m.span() for m in WORD.finditer(low)], _places(text, low)
                start, stop = spans[best[1]][0], spans[best[2] - 1][1]
                if places is not None:
                    start, stop = int(places[start]), int(places[stop - 1]) + 1
                out.append((item, best[0], start, stop))
        return sorted(out)


def leaks(documents: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, item_id, n_words, start_char, end_char)`` of every leak; items: item_id, text."""
    passage = passages(items.select("item_id", "text"))
    size = passage.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    fields = [StructField("item_id", LongType()), *(StructField(n, IntegerType()) for n in ("n_words", "start_char", "end_char"))]
    out = []
    for block in range(blocks):
        mine = passage.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else passage
        listed = documents.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in mine.collect()])  # about BLOCK characters
        out.append(explode_texts(documents, [key], text, lambda listed=listed: Scanner(listed.value).scan, fields))
    return reduce(DataFrame.unionByName, out)
