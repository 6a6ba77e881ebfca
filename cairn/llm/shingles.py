"""Word shingles as 64-bit numbers, vectorised over the words of a text."""

from __future__ import annotations

import re

import numpy as np
import regex
import xxhash

#: A word is a run of letters, marks and digits; scripts written without spaces count by character.
WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*|[\p{L}\p{N}\p{M}]+")

#: The same for sets of shingles, where marks may split a word as long as they always do.
_WORDS = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\W_\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")

_numbers: dict[str, int] = {}


def _number(word: str) -> int:
    value = _numbers.get(word)
    if value is None:
        if len(_numbers) > 1_000_000:
            _numbers.clear()
        value = _numbers[word] = xxhash.xxh64_intdigest(word)
    return value


def word_numbers(text: str) -> np.ndarray:
    """A 64-bit number for every word of a text, in lower case, without punctuation."""
    return np.array([_number(w) for w in WORD.findall(text.lower())], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Bits of a shingle's number, and what they leave for the rows of one batch.
BITS = 53
ROWS = 1 << (64 - BITS)


class TokenBatch:
    """Shingle sets of many rows of messages at once.

    ``row``, ``token`` (:data:`BITS` bits) hold the distinct shingles of all rows, ordered by row and
    token; ``message_row``, ``message`` one number per distinct non-empty message of each row, if asked for.  A
    batch has at most :data:`ROWS` rows, so that row and token fit one number and sort as one.
    """

    def __init__(self, texts: list[str | None], owner: np.ndarray, size: int, messages: bool = True) -> None:
        found = [_WORDS.findall(t.lower()) if t else () for t in texts]
        length = np.fromiter(map(len, found), np.int64, len(found))
        keep = length > 0
        length, owner = length[keep], owner[keep].astype(np.int64)
        flat = [w for f in found for w in f]
        number = {w: _number(w) for w in set(flat)}
        words = np.fromiter(map(number.__getitem__, flat), np.uint64, len(flat))
        end = np.cumsum(length)
        start = end - length
        if not len(words):
            self.row = self.message_row = np.empty(0, np.int64)
            self.token, self.message = np.empty(0, np.uint64), np.empty(0, np.uint64)
            return
        if messages:
            place = np.arange(len(words)) - np.repeat(start, length)
            powers = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
            whole = mix(np.add.reduceat(words * powers[place], start) + length.astype(np.uint64))
            self.message_row, self.message = _distinct(owner, whole)
        own = np.repeat(owner, length)
        left = np.repeat(end, length) - np.arange(len(words))
        rows, tokens = [], []
        for s in range(1, size + 1):
            # a message shorter than a shingle is one shingle
            at = np.flatnonzero(left >= size) if s == size else start[length == s]
            if len(at):
                number = np.zeros(len(at), dtype=np.uint64)
                for k in range(s):
                    number = number * np.uint64(0x9E3779B97F4A7C15) + words[at + k]
                rows.append(own[at])
                tokens.append(mix(number + np.uint64(s)) >> np.uint64(64 - BITS))
        key = np.sort((np.concatenate(rows).astype(np.uint64) << np.uint64(BITS)) | np.concatenate(tokens))
        key = key[np.r_[True, key[1:] != key[:-1]]]
        self.row, self.token = (key >> np.uint64(BITS)).astype(np.int64), key & np.uint64((1 << BITS) - 1)


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((value, row))
    row, value = row[by], value[by]
    first = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])]
    return row[first], value[first]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Numbers of all runs of ``size`` words; a shorter text is one run."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k]
    return mix(out + np.uint64(size))
