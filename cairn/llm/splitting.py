"""Splitting oversized texts at natural boundaries.

A text is first cut recursively by a hierarchy of separators: sections, paragraphs, sentences, words,
characters.  A finer level is used only inside a unit that still exceeds what one piece can take.
The units are then packed greedily up to the byte limit, and each piece starts a little before the
end of the one before it: by as much as fits into the overlap, at a unit or word boundary where
there is one, and by one character at least.

All pieces are slices ``text[start:end]`` of the original, so nothing is normalised or lost: pieces
without their overlap, put together, are the text.

Defined results: null and empty texts have no pieces; a text within the limit is one piece; repeated
rows are split alike; the limit must exceed the overlap by at least 8 bytes, so that any character
fits.  Very long texts are split in one pass over their characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField

from cairn.llm.arrow import explode_texts

#: Separators from coarse to fine; each match ends a unit.
LEVELS = tuple(
    re.compile(p)
    for p in (
        r"\n[ \t]*\n[ \t]*(?:\n[ \t]*)+|\n(?=#{1,6} )|\n(?:-{3,}|={3,}|\*{3,})[ \t]*\n",  # sections
        r"\n[ \t]*\n\s*",  # paragraphs
        r"\n|[.!?…؟۔।॥]+[\"'”’»)\]]*\s+|[。！？｡]+[」』”’）]*",  # sentences and lines
        r"\s+|[、，；：]",  # words
    )
)


def _cuts(text: str, at: np.ndarray, start: int, end: int, room: int, level: int, out: list[int]) -> None:
    """Append the ends of the units of ``text[start:end]``, each at most ``room`` bytes."""
    stack = [(start, end, level)]
    while stack:
        s, e, lv = stack.pop()
        if at[e] - at[s] <= room:
            out.append(e)
            continue
        if lv == len(LEVELS):
            while at[e] - at[s] > room:
                nxt = max(s + 1, int(np.searchsorted(at, at[s] + room, side="right")) - 1)
                out.append(nxt)
                s = nxt
            out.append(e)
            continue
        ends = [m.end() for m in LEVELS[lv].finditer(text, s, e) if s < m.end() < e] + [e]
        begins = [s, *ends[:-1]]
        stack.extend((b, x, lv + 1) for b, x in zip(reversed(begins), reversed(ends)))


def split(text: str, limit: int = 4000, overlap: int = 200) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of a text, in characters."""
    if limit < overlap + 8:
        raise ValueError("the limit must exceed the overlap by at least 8 bytes")
    if not text:
        return []
    sizes = np.ones(len(text), dtype=np.int64)
    if not text.isascii():
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes += (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.concatenate(([0], np.cumsum(sizes)))
    if at[-1] <= limit:
        return [(0, len(text))]
    units: list[int] = []
    _cuts(text, at, 0, len(text), limit - max(overlap, 4), 0, units)
    words = [m.end() for m in LEVELS[-1].finditer(text)]
    pieces, start, k = [], 0, 0
    while k < len(units):
        end = units[k]
        while k + 1 < len(units) and at[units[k + 1]] - at[start] <= limit:
            k += 1
            end = units[k]
        pieces.append((start, end))
        k += 1
        if k == len(units):
            break
        low = int(np.searchsorted(at, at[end] - overlap, side="left"))  # earliest start within the overlap
        low = min(max(low, start + 1), end - 1)
        i = bisect_left(units, low)
        if units[i] < end:
            start = units[i]
        else:
            j = bisect_left(words, low)
            start = words[j] if j < bisect_right(words, end - 1) else low
    return pieces


_OUT = [StructField("piece_no", IntegerType()), StructField("n_pieces", IntegerType()), StructField("start_char", IntegerType()), StructField("end_char", IntegerType()), StructField("piece", StringType())]


def split_table(df: DataFrame, keys: list[str], text: str, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """Pieces of all rows of ``df`` whose text exceeds ``limit`` bytes in UTF-8, with ``keys``.

    Only those rows leave the JVM.
    """
    if limit < overlap + 8:
        raise ValueError("the limit must exceed the overlap by at least 8 bytes")

    def make():
        def pieces(t: str | None) -> list[tuple]:
            spans = split(t or "", limit, overlap)
            return [(n, len(spans), s, e, t[s:e]) for n, (s, e) in enumerate(spans)]

        return pieces

    return explode_texts(df.where(F.octet_length(text) > limit), keys, text, make, _OUT)
