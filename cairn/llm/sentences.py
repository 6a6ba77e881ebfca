"""Sentence boundaries across languages and scripts.

Layout comes first: blank lines end everything; a heading, a list item and a fenced code block are
one unit each; the other lines of a block are one paragraph.  Within a paragraph a boundary may
follow a run of characters with the Unicode property Sentence_Terminal (which covers the terminators
of all scripts), an ellipsis, a closing emoji, or, in Thai, a space.  Whether it does is decided from
what stands around it:

* nothing ends inside a closed pair of quotation marks or brackets; right behind one, only a new
  sentence (not a lower-case or, after quotations, caseless continuation) starts a unit;
* a full stop followed by anything but white space ends nothing (decimals, versions, addresses), nor
  does one before a lower-case word;
* abbreviations suppress a full stop: always, before a digit, or, for those that can close a
  sentence, only before lower case; initials and German ordinals likewise.  They act in their own
  language only: that of the paragraph by its script or function words, else that of the document,
  else any; a street's "St." behind its name may close a sentence, a saint's before one may not;
* terminators of scripts without spaces end a sentence without one.

Lines end at all of the standard's mandatory breaks; a paragraph separator ends a paragraph as well.
Every non-blank character belongs to exactly one unit.

Defined results: null, empty and blank texts have no sentences; unclosed quotations, brackets and
fences do not swallow more than their paragraph (a fence: the rest of the text); repeated rows give
equal results; time grows linearly with the text.
"""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField

from cairn.llm.arrow import explode_texts

# Abbreviations by language, lower case, without the last full stop.
#: Before a name, with a capital where the script has them; never at the end of a sentence.
TITLES = {
    "en": "dr mr mrs ms prof rev gen col capt lt sgt hon st mt",
    "de": "dr prof hr fr dipl ing st",
    "fr": "dr prof m mm mlle pr st ste",
    "es": "dr prof sr sra srta dra ud uds lic ing av dña",
    "ar": "د أ م ص ا",
    "hi": "डॉ प्रो श्री",
    "th": "ดร นพ",
    "ru": "проф акад доц",
}
#: Never at the end of a sentence.
INNER = {
    "en": "vs cf e.g i.e viz",
    "de": "vs cf bzw bzgl z.b d.h u.a ggf vgl inkl exkl zzgl sog evtl i.d.r u.u s.o s.u",
    "fr": "cf p.ex c.-à-d",
    "es": "cf p.ej ej ee",
    "ru": "проф см напр им акад доц ул т.е т.к",
}
#: Not the end of a sentence before a number.
BEFORE_NUMBER = {
    "en": "no nos nr fig figs sec secs ch chs p pp vol vols art eq par approx est ca circa jan feb mar apr jun jul aug sep sept oct nov dec",
    "de": "nr art abs s bd kap abb tab ziff ca jan feb mär apr jun jul aug sep sept okt nov dez",
    "fr": "no nos n art p pp vol fig env chap v ex janv févr avr juil sept oct nov déc",
    "es": "no nos n art p pp vol aprox pág págs fig núm cap ca",
    "ru": "ок стр рис гл ст кв д г тыс",
}
#: Words that tell the languages of the Latin script apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with was on are this be by at from have not an as or he she",
    "de": "der die das und ist nicht mit ein eine zu den von im auf für sich dem auch wird es als an bei nach aus war am noch nur",
    "fr": "le la les et des est que une dans pour du il elle sur pas au qui ce avec sont",
    "es": "el los las y que una por con para del se es en la como su al lo más pero",
}

#: Words before a German ordinal.
BEFORE_ORDINAL = frozenset("der die das dem den des am im vom zum zur beim".split())

OPENERS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "‹": "›", "《": "》", "〈": "〉", "【": "】", '"': '"'}
BRACKETS = frozenset("([（【")
_PAIR_CHARS = regex.compile(r"[“”„«»「」『』()（）\[\]‹›《》〈〉【】\"]")
_CANDIDATE = regex.compile(
    r"(?P<term>[\p{Sentence_Terminal}…]+)"
    r"|(?P<emoji>(?![©®™])\p{Extended_Pictographic}[️‍\U0001F3FB-\U0001F3FF\p{Extended_Pictographic}]*(?=\s))"
    r"|(?P<thai>(?<=[\p{Thai}\p{N}\p{Pe}\p{Pf}])\s+(?=\p{Thai}))"
)
_CLOSERS = regex.compile(r"[\p{Pe}\p{Pf}\"'”’»]*")
_SPACE_CLOSE = regex.compile(r"\s*")
_SPACE = regex.compile(r"\s*")
_LEAD = regex.compile(r"[\s\p{Ps}\p{Pi}\"'„¿¡*_]*")
_BEFORE = regex.compile(r"[\p{L}\p{M}.\-]*$")
_NUMBER_BEFORE = regex.compile(r"(?:^|\s)(\p{L}+)\s+\d{1,3}$")
_EMOJI = regex.compile(r"(?:\s*(?![©®™])\p{Extended_Pictographic}[️‍\U0001F3FB-\U0001F3FF\p{Extended_Pictographic}]*)+")
_WIDE = frozenset("。！？｡．")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_LIST = regex.compile(r"[ \t]*(?:[-*+•‣◦]|\d{1,3}[.)])[ \t]+\S")
_HEADING = regex.compile(r"[ \t]{0,3}#{1,6}[ \t]+\S")
_FENCE = regex.compile(r"[ \t]{0,3}(```+|~~~+)")
_BREAKS = "\n\v\f\r\x85\u2028\u2029"
_LINE = regex.compile(rf"[^{_BREAKS}]*(?:\r\n|[{_BREAKS}])?")
_SCRIPTS = {"ru": regex.compile(r"\p{Cyrillic}"), "ar": regex.compile(r"\p{Arabic}"), "hi": regex.compile(r"\p{Devanagari}"), "th": regex.compile(r"\p{Thai}")}
_WORD = regex.compile(r"\p{L}+")


def _merged(table: dict[str, str]) -> dict[str, frozenset]:
    """Which languages an abbreviation belongs to."""
    words = {w for listed in table.values() for w in listed.split()}
    return {w: frozenset(k for k, listed in table.items() if w in listed.split()) for w in words}


_TITLES, _INNER, _BEFORE_NUMBER, _TELLING = map(_merged, (TITLES, INNER, BEFORE_NUMBER, FUNCTION_WORDS))


class _Tongue:
    """The languages of a paragraph, found when first asked for."""

    def __init__(self, text: str, s: int, e: int, lang: str | None) -> None:
        self._place, self._lang, self._found = (text, s, e), (lang or "").strip().lower()[:2], None

    def speaks(self, languages: frozenset | None) -> bool:
        """Whether an abbreviation of ``languages`` acts here."""
        if not languages:
            return False
        if self._found is None:
            self._found = self._detect()
        return not self._found or bool(self._found & languages)

    def _detect(self) -> frozenset:
        text, s, e = self._place
        part = text[s:e]
        of = {k: len(p.findall(part)) for k, p in _SCRIPTS.items()}
        votes = dict.fromkeys(FUNCTION_WORDS, 0)
        letters = 0
        for word in _WORD.findall(part.lower()):
            letters += len(word)
            for k in _TELLING.get(word, ()):
                votes[k] += 1
        most = max(of, key=of.get)
        if of[most] * 2 > letters:
            return frozenset([most])
        top = max(votes.values())
        best = frozenset(k for k, v in votes.items() if v == top) if top else frozenset()
        if self._lang in FUNCTION_WORDS and (not best or self._lang in best):
            return frozenset([self._lang])
        return best


def _pairs(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """Outermost closed pairs of quotation marks and brackets, as (opener, closer) positions."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _PAIR_CHARS.finditer(text, s, e):
        c, i = m.group(), m.start()
        if c == '"':
            opened = any(o == '"' for o, _ in stack)
            closes = opened
        else:
            closes = any(c in OPENERS[o] for o, _ in stack)
        if closes:
            while stack:
                o, j = stack.pop()
                if c in OPENERS[o]:
                    found.append((j, i))
                    break
        elif c in OPENERS:
            stack.append((c, i))
    found.sort()
    outer: list[tuple[int, int]] = []
    for j, i in found:
        if not outer or j > outer[-1][1]:
            outer.append((j, i))
    return outer


def _is_street(before: str) -> bool:
    """Whether "St" follows a name and not only the opening of its sentence."""
    words = before.rsplit(None, 2)
    return len(words) == 3 and words[1][:1].isupper() and not words[1].endswith((".", "!", "?"))


def _dot_ends(text: str, s: int, at: int, nxt: str, tongue: _Tongue) -> bool:
    """Whether a single full stop at ``at``, before white space and then ``nxt``, ends a sentence."""
    if nxt.islower():
        return False
    before = text[max(s, at - 24) : at]
    word = _BEFORE.search(before).group().lstrip("-.")
    low = word.lower()
    if low in _INNER and ("." in low or tongue.speaks(_INNER[low])):  # with full stops inside, it is no other word
        return False
    title = low.rpartition("-")[2]
    if title in _TITLES and not word[0].islower() and not (title == "st" and _is_street(before)) and tongue.speaks(_TITLES[title]):
        return False
    if nxt.isdigit():
        return not tongue.speaks(_BEFORE_NUMBER.get(low))
    if len(word) == 1 and word.isupper() and nxt.isupper():
        return False  # an initial
    if not word and before[-1:].isdigit() and nxt.isupper():
        ordinal = _NUMBER_BEFORE.search(before)
        if ordinal and ordinal.group(1).lower() in BEFORE_ORDINAL:
            return False
    return True


def _paragraph(text: str, s: int, e: int, out: list[tuple[int, int]], lang: str | None = None) -> None:
    pairs = _pairs(text, s, e)
    tongue = _Tongue(text, s, e, lang)
    k = 0
    start = s
    skip = s
    thai_seen = s

    def close(end: int, nxt: int) -> None:
        nonlocal start
        out.append((start, end))
        start = nxt

    for m in _CANDIDATE.finditer(text, s, e):
        a, b = m.span()
        if a < skip:
            continue
        while k < len(pairs) and pairs[k][1] < a:
            k += 1
        inside = k < len(pairs) and pairs[k][0] < a
        if m.lastgroup == "thai":
            if not inside and regex.search(r"\p{Thai}", text[max(start, thai_seen) : a]):
                close(a, b)
            continue
        quoted = False
        if inside:
            closer = pairs[k][1]
            if _SPACE_CLOSE.match(text, b, e).end() != closer:
                continue
            quoted = text[pairs[k][0]] not in BRACKETS
            end = closer + 1
        else:
            end = b
        end = _CLOSERS.match(text, end, e).end()
        emoji = _EMOJI.match(text, end, e)
        if emoji:
            end = emoji.end()
        skip = end
        if end >= e:
            break
        nxt = _SPACE.match(text, end, e).end()
        if nxt >= e:
            break
        run = m.group()
        lead = _LEAD.match(text, nxt, e).end()
        look = text[lead] if lead < e else ""
        if nxt == end:  # no white space behind
            if quoted or inside:
                continue
            if run[-1] in _WIDE or run[-1] in "।॥" or (run[-1] in "…!?" and (_UNSPACED.match(look) or _UNSPACED.match(text[a - 1 : a]))):
                close(end, nxt)
            continue
        continues = look.islower() or (quoted and look.isalpha() and not look.isupper())
        if m.lastgroup == "emoji" or emoji:
            ends = not look.islower()
        elif run == ".":
            ends = not continues and _dot_ends(text, start, a, look or text[nxt], tongue) if not inside else not continues
        elif run[-1] in ".…":
            ends = not continues
        else:
            ends = not (quoted and continues) and not (inside and look.islower())
        if ends:
            close(end, nxt)
    if start < e:
        out.append((start, e))


def sentences(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """``(start, end)`` of the sentence units of a text, in characters, without outer blanks.

    ``lang`` counts only where the text itself does not tell.
    """
    if not text:
        return []
    raw: list[tuple[int, int]] = []
    block: list[int] | None = None

    def flush() -> None:
        nonlocal block
        if block:
            s, e = block
            _paragraph(text, s, e, raw, lang)
        block = None

    pos, n = 0, len(text)
    while pos < n:
        m = _LINE.match(text, pos)
        s, e = m.span()
        pos = e
        line = text[s:e]
        if not line.strip():
            flush()
        elif fence := _FENCE.match(line):
            flush()
            mark = fence.group(1)
            end = e
            while pos < n:
                t = _LINE.match(text, pos)
                pos = end = t.end()
                if t.group().strip().startswith(mark):
                    break
            raw.append((s, end))
        elif _HEADING.match(line) or _LIST.match(line):
            flush()
            raw.append((s, e))
        elif block:
            block[1] = e
        else:
            block = [s, e]
        if line.endswith("\u2029"):
            flush()
    flush()
    out = []
    for s, e in raw:
        piece = text[s:e]
        left = len(piece) - len(piece.lstrip())
        right = len(piece.rstrip())
        if right > left:
            out.append((s + left, s + right))
    return out


def sentence_table(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """``(key, sentence_no, start_char, end_char)`` of all sentences; ``lang`` names the column of the language."""
    fields = [StructField(n, IntegerType()) for n in ("sentence_no", "start_char", "end_char")]
    return explode_texts(df, [key], text, lambda: lambda t, k=None: [(i, s, e) for i, (s, e) in enumerate(sentences(t, k))], fields, also=lang)
