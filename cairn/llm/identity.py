"""Personal information in free text: bootstrapped contextual extraction and typed placeholders.

1. *Candidates.*  One pass over each text marks everything that has the outline of a mention: digit
   and letter groups, pairs of capitalised words, house numbers beside words, addresses with an @ (or
   spelt out).  A candidate has an *instance* key, what would let an unseen mention be recognised
   (the digit mask of a number, the first name, the street word, the signs that part an email), and a
   *pattern*, the words around.  Emails and addresses of a known build are marked as such; others of a
   wider outline (house number and capitalised words before a town; words parted by any form of "at"
   and "dot") are candidates that only the bootstrap can confirm.
2. *Bootstrap.*  Seed instances (below) start with score 1.  Each round, until the known instances stand
   still, a pattern's score is the
   share of its occurrences that known instances fill, and an instance's score the share of its
   occurrences that stand in telling patterns (score over a threshold, seen with several instances); instances over a threshold are known in the next round, seeds always.  Shares of
   occurrences, not of distinct instances, keep words that stand everywhere from drifting in.  The
   graph is aggregated: its size follows the distinct masks, names and contexts, not the text.
3. *Decision.*  A candidate is a mention if its instance is known and, for numbers, its pattern is not
   one that surrounds other things, or if its pattern is nearly always filled by known instances.
   A wider outline of an email or address needs a pattern that tells besides a known instance.
4. *Redaction.*  Mentions are replaced from the right by placeholders such as ``[EMAIL]``.

Everything after the candidate pass is joins and partial aggregations on keys; nothing is collected,
no lexicon is broadcast, and texts cross the shuffle only for redaction, and only those with mentions.

Defined results: null and empty texts have no mentions and stay as they are; of overlapping
candidates the longer one wins, ties by type order; a text repeated under another key yields equal
mentions; positions are in characters; time grows linearly with the text.
"""

from __future__ import annotations

import re
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField

from cairn.durable import Workspace
from cairn.llm.arrow import explode_texts

TYPES = ("email", "address", "id_number", "phone", "person_name")
PLACEHOLDERS = {"email": "[EMAIL]", "address": "[ADDRESS]", "id_number": "[ID_NUMBER]", "phone": "[PHONE]", "person_name": "[PERSON_NAME]"}

# Seeds.  Number masks write 9 for a digit and A for a capital.
SEEDS = {
    "phone": ["+99 99 99999999", "(999) 999-9999", "999-999-9999", "+9 999 999 9999", "+99 9999 999 999", "+99 9 99 99 99 99", "+99999999999"],
    "id_number": ["999-99-9999", "AA999999A", "A9999999A", "AA9999999"],
    "person_name": "anna maria john james peter paul thomas david michael elena sofia rosa omar karim samir marta pedro klara ingrid hugo bruno nils jonas stefan lukas leila priya yuki".split(),
    "address": ["street", "avenue", "rue", "calle", "straße", "road", "ave", "rd"],
    "email": ["@ ."],
}

#: Rounds after which the scores are taken as they are, should they not stand still before.
MOST_ROUNDS = 12
#: A pattern must surround so many distinct instances to say anything about them.
SUPPORT = 2
TELLING, KNOWN, FREE, HOSTILE = 0.15, 0.25, 0.8, 0.15

_LABEL = r"[A-Za-z0-9](?:[\w-]*\w)?"
_DOT = r"\s?(?:\[dot\]|\(dot\)|\{dot\}|\sdot\s)\s?"
_LOCAL = r"(?<![\w.+@-])[A-Za-z0-9][\w.+-]*"
_EMAIL = regex.compile(
    rf"{_LOCAL}@{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}(?![\w@])"
    rf"|{_LOCAL}\s?(?:\[at\]|\(at\)|\{{at\}})\s?{_LABEL}(?:(?:{_DOT}|\.){_LABEL})*(?:{_DOT}|\.)[A-Za-z]{{2,}}\b"
    rf"|{_LOCAL}\sat\s{_LABEL}(?:(?:{_DOT}|\.){_LABEL})*{_DOT}[A-Za-z]{{2,}}\b",
    regex.IGNORECASE,
)
_NUMBER = regex.compile(
    r"(?<![\w@/.\-+])(?:"
    r"[A-Z]{2} \d\d ?\d\d ?\d\d ?[A-Z]"  # letters, spaced pairs, letter
    r"|[A-Z]{1,2}\d(?:-?\d){5,11}[A-Z]?"  # letters in front
    r"|\d{6,12}-?[A-Z]"  # a letter behind
    r"|(?:\+|\()?\d(?:[ .\-/]?\(?\d|\)[ .\-/]?\d){5,16}"  # digits in groups
    r")(?![\w@]|[.\-/]\w)",
    regex.IGNORECASE,
)
#: Words parted by some form of "at" and some form of "dot".
_AT = r"\s{0,2}[^\w\s]{0,2}\s?(?:@|\bat\b|\barroba\b)\s?[^\w\s]{0,2}\s{0,2}"
_ANY_DOT = r"\.|\s\.\s?|\s{0,2}[^\w\s]{0,2}\s?\b(?:dot|punto|point)\b\s?[^\w\s]{0,2}\s{0,2}"
_WIDE_EMAIL = regex.compile(rf"(?<![\w.+@-])[A-Za-z][\w.+-]*(?P<at>{_AT})[A-Za-z][\w-]*(?:(?P<dot>{_ANY_DOT})[A-Za-z][\w-]*)+(?![\w@])", regex.IGNORECASE)
#: What a text must hold for the wider outlines to be looked for; quick to test.
_AT_AND_DOT = re.compile(r"(?:\bat\b|\barroba\b|@)[^\w\n]{0,5}[a-z][\w-]*(?:\.|\s\.\s?|[^\w\n]{0,5}\b(?:dot|punto|point)\b[^\w\n]{0,5})[a-z]")
_NUMBER_CAPITAL, _NUMBER_POST = re.compile(r"\d[A-Za-z]? [^\W\d_a-z]"), re.compile(r"\d[a-z]?,\s\d{5} ")
_WORD = r"\p{L}[\p{L}\p{M}'’]*"
_CAP = r"\p{Lu}[\p{Ll}\p{M}'’]+(?:-\p{Lu}[\p{Ll}\p{M}'’]+)*"
_NAME = regex.compile(rf"(?<![\w-])(?P<first>{_CAP})(?=(?P<rest>(?:[ ]\p{{Lu}}\.)*(?:[ ](?:van der|van den|van|von|de la|del|de|di|da|dos|bin|ibn|al|el|le|la|ter))?[ ]{_CAP})(?!\w))")
_TURNED = regex.compile(rf"(?<![\w-])(?:(?:VAN|VON|DE|DI|DA|LA) )*\p{{Lu}}{{3,}}(?:[-'’]\p{{Lu}}+)*, (?P<first>{_CAP})(?!\w)")
_ANYNAME = regex.compile(rf"(?<![\w-])(?P<first>{_WORD}(?:-{_WORD})*)(?=(?P<rest>(?:[ ]\p{{L}}\.)*(?:[ ](?:van der|van den|van|von))?[ ]{_WORD}(?:-{_WORD})*)(?![\w]))", regex.IGNORECASE)
_TOWN = rf"{_CAP}(?:[ ](?:(?:on|upon|am|an der|sur|del|de la|de)[ ])?{_CAP})??"
_POST = r"\d{5}"
_ADDRESS = [
    # number, name, street word, unit, town
    (
        rf"(?:(?:Unit|Apt|Flat|Suite) \d+[A-Za-z]?, )?\d{{1,5}}[A-Za-z]?,? (?:{_CAP} ){{1,3}}?(?P<key>Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Court|Ct|Drive|Dr|Boulevard|Blvd|Place|Pl|Square|Sq|Way|Close|Terrace|Crescent|Row)\b\.?"
        rf"(?:,? (?:Apt|Flat|Unit|Suite|No)\.? ?#?\d+[A-Za-z]?)?(?:,\s?|\n){_CAP}(?:,? [A-Z]{{2}} {_POST}| [A-Z]{{1,2}}\d{{1,2}}[A-Z]? \d[A-Z]{{2}})?"
    ),
    rf"\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?P<key>rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours)(?: (?:de la|de l'|des|du|de|d'|l'))? ?{_CAP}(?: {_CAP})?,\s(?:{_POST} )?{_CAP}",
    rf"(?P<key>Calle|Avenida|Plaza|Paseo|Camino|Via|Viale|Piazza|Rua)(?: (?:del|de la|de los|de las|de|della|di))? {_CAP}(?: {_CAP})?,? \d{{1,4}}(?:, ?\d{{1,2}}\.?[º°ª](?: ?[A-Z])?)?,\s(?:{_POST} )?{_CAP}",
    rf"\p{{Lu}}[\p{{Ll}}\p{{M}}]+?(?P<key>straße|strasse|weg|gasse|allee|platz|ufer|damm|ring)\b \d{{1,4}} ?[a-z]?,\s(?:{_POST} )?{_CAP}",
]
#: A house number beside capitalised words, before a town.
_WIDE_ADDRESS = [
    regex.compile(rf"(?<![\w.,#-])\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}?(?P<key>{_CAP}),\s(?:{_POST} )?{_CAP}(?:,? [A-Z]{{2}} {_POST})?(?![\w])"),
    regex.compile(rf"(?<![\w-])(?P<key>{_CAP})(?: {_CAP}){{0,2}} \d{{1,4}}[a-z]?,\s{_POST} {_CAP}(?![\w])"),
]
_ADDRESS_EXACT = [regex.compile(p) for p in _ADDRESS]
_ADDRESS_ANY = [regex.compile(p, regex.IGNORECASE) for p in _ADDRESS]
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}_'’]+|[^\s\p{L}\p{M}\p{N}]")
_DIGIT, _LETTER = regex.compile(r"\d"), regex.compile(r"[A-Za-z]")


def mask(number: str) -> str:
    """Digits as 9, letters as A, separators kept."""
    return _LETTER.sub("A", _DIGIT.sub("9", number))


def _patterns(text: str, a: int, b: int) -> tuple[str, str]:
    """The two words before, and the token on either side; digits masked, lower case."""
    before = _TOKEN.findall(text[max(0, a - 48) : a])
    after = _TOKEN.findall(text[b : b + 20])[:1]
    left = _DIGIT.sub("9", " ".join([t for t in before if t[0].isalnum()][-2:]).lower())
    return f"{left} _", _DIGIT.sub("9", f"{before[-1] if before else ''} _ {after[0] if after else ''}".lower())


def candidates(text: str | None) -> list[tuple[str, int, int, str, str, str]]:
    """``(kind, start, end, instance, left, around)`` of everything in the outline of a mention."""
    if not text or text.isspace():
        return []
    out: list[tuple[str, int, int, str]] = []
    single = text == text.lower() or text == text.upper()
    taken: list[tuple[int, int]] = []
    low = text.lower()
    if "@" in text or "dot" in low or "(at)" in low or "[at]" in low:
        for m in _EMAIL.finditer(text):
            out.append(("email", *m.span(), "@ ." if "@" in m.group() else "(at) (dot)"))
            taken.append(m.span())
    if _AT_AND_DOT.search(low):
        for m in _WIDE_EMAIL.finditer(text):
            if not any(x < m.end() and m.start() < y for x, y in taken):
                out.append(("wide_email", *m.span(), f"{m.group('at').strip().lower()} {m.group('dot').strip().lower()}"))
    if _DIGIT.search(text):
        for p in _ADDRESS_ANY if single else _ADDRESS_EXACT:
            for m in p.finditer(text):
                if not any(x < m.end() and m.start() < y for x, y in taken):
                    out.append(("address", *m.span(), m.group("key").lower()))
                    taken.append(m.span())
        for p, quick in () if single else zip(_WIDE_ADDRESS, (_NUMBER_CAPITAL, _NUMBER_POST)):
            for m in p.finditer(text) if quick.search(text) else ():
                if not any(x < m.end() and m.start() < y for x, y in taken):
                    out.append(("wide_address", *m.span(), m.group("key").lower()))
        for m in _NUMBER.finditer(text):
            a, b = m.span()
            while text[a] == "(" and ")" not in text[a:b]:
                a += 1
            if sum(c.isdigit() for c in text[a:b]) >= 6 and not any(x < b and a < y for x, y in taken):
                out.append(("number", a, b, mask(text[a:b])))
    if "," in text and not single:
        for m in _TURNED.finditer(text):
            out.append(("person_name", *m.span(), m.group("first").partition("-")[0].lower()))
            taken.append(m.span())
    for m in (_ANYNAME if single else _NAME).finditer(text):
        a, b = m.start(), m.end("rest")
        if not any(x < b and a < y for x, y in taken):
            out.append(("loose_name" if single else "person_name", a, b, m.group("first").partition("-")[0].lower()))
    return [(kind, a, b, key, *_patterns(text, a, b)) for kind, a, b, key in out]


_FIELDS = [StructField("kind", StringType()), StructField("start_char", IntegerType()), StructField("end_char", IntegerType()), *(StructField(n, StringType()) for n in ("instance", "left", "around"))]


def candidate_table(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Candidates of all texts, with the row's keys."""
    return explode_texts(texts, keys, text, lambda: candidates, _FIELDS)


def _edges(found: DataFrame) -> DataFrame:
    """The graph: (kind, instance, pattern) with the number of occurrences, both pattern forms."""
    both = F.explode(F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("A "), "around"))).alias("pattern")
    kind = F.regexp_replace("kind", "^wide_", "").alias("kind")  # wider outlines share the graph of their kind
    return found.where("kind <> 'loose_name'").select(kind, "instance", both).groupBy("kind", "instance", "pattern").agg(F.count("*").alias("c"))


def _types(kind: str) -> list[str]:
    return ["phone", "id_number"] if kind == "number" else [kind]


def _seeds(spark: SparkSession) -> DataFrame:
    kinds = {t: k for k in ("number", "person_name", "address", "email") for t in _types(k)}
    return spark.createDataFrame([(kinds[t], t, i) for t, seeds in SEEDS.items() for i in seeds], "kind string, type string, instance string")


def bootstrap(found: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """Scores of instances ``(kind, type, instance, score)`` and patterns ``(kind, type, pattern, score)``."""
    spark = found.sparkSession
    edges = space.cut(_edges(found), "edges")
    wide = edges.groupBy("kind", "pattern").agg(F.count("*").alias("n"), F.sum("c").alias("all")).where(F.col("n") >= SUPPORT)
    every, edges = edges, space.cut(edges.join(wide, ["kind", "pattern"]), "supported")
    space.release(every)
    seeds = _seeds(spark).withColumn("score", F.lit(1.0))
    seen = edges.groupBy("kind", "instance").agg(F.sum("c").alias("times"))
    scores, patterns, before = seeds, None, None
    for _ in range(MOST_ROUNDS):
        known = scores.where(F.col("score") >= KNOWN).select("kind", "type", "instance")
        space.release(patterns)
        patterns = space.cut(edges.join(known, ["kind", "instance"]).groupBy("kind", "pattern", "type").agg((F.sum("c") / F.max("all")).alias("score"), F.max("n").alias("n")), "patterns")
        telling = patterns.where(F.col("score") >= TELLING).drop("n")
        raised = edges.select("kind", "instance", "pattern", "c").join(telling, ["kind", "pattern"]).groupBy("kind", "instance", "type").agg(F.sum("c").alias("told"), F.count("*").alias("k"))
        fresh = raised.join(seen, ["kind", "instance"]).where(F.col("k") >= SUPPORT).select("kind", "type", "instance", (F.col("told") / F.col("times")).alias("score"))
        last, scores = scores, space.cut(fresh.unionByName(seeds.select("kind", "type", "instance", "score")).groupBy("kind", "type", "instance").agg(F.max("score").alias("score")), "instances")
        space.release(last)
        named = scores.where(F.col("score") >= KNOWN).select(F.xxhash64("kind", "type", "instance").alias("h"))
        now = named.agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)"))).first()  # a digest of the set
        if now == before:
            break
        before = now
    space.release(edges)
    return scores, patterns


def mentions(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys, pii_type, start_char, end_char)`` of all mentions in ``texts``."""
    space = Workspace(texts.sparkSession, "identity")
    found = space.cut(candidate_table(texts, keys, text), "candidates")
    instances, patterns = bootstrap(found, space)
    spot = [*keys, "kind", "start_char", "end_char"]
    known = instances.where(F.col("score") >= KNOWN).select("kind", "instance", "type", F.col("score").alias("si"))
    pick = lambda s: patterns.where(F.col("pattern").startswith(s + " ")).select("kind", "type", F.substring("pattern", 3, 1 << 20).alias({"L": "left", "A": "around"}[s]), F.col("score").alias(f"p{s}"), F.col("n").alias(f"n{s}"))
    # a text without case has too many word pairs to learn from; its names must be known
    loose = F.col("kind") == "loose_name"
    wide = F.col("kind").startswith("wide_")
    rest = found.where(F.col("kind") != "email").withColumns({"loose": loose, "wide": wide})
    rest = rest.withColumn("kind", F.when(loose, "person_name").otherwise(F.regexp_replace("kind", "^wide_", "")))
    kinds = texts.sparkSession.createDataFrame([(k, t) for k in ("number", "person_name", "address", "email") for t in _types(k)], "kind string, type string")
    typed = rest.join(F.broadcast(kinds), "kind")  # five fixed rows
    judged = (
        typed.join(known, ["kind", "instance", "type"], "left").join(pick("L"), ["kind", "type", "left"], "left").join(pick("A"), ["kind", "type", "around"], "left")
    )
    seen = judged.withColumn("best", F.greatest(F.coalesce("pL", F.lit(0.0)), F.coalesce("pA", F.lit(0.0))))
    support = F.greatest(F.coalesce("nL", F.lit(0)), F.coalesce("nA", F.lit(0)))
    hostile = (F.col("kind") == "number") & (support >= 3) & (F.col("best") < HOSTILE)
    free = ((F.col("pL") >= FREE) & (F.col("nL") >= 3)) | ((F.col("pA") >= FREE) & (F.col("nA") >= 3))
    told = F.col("si").isNotNull() & ~hostile & (~F.col("wide") | (F.col("best") >= TELLING))
    taken = seen.where(told | (~F.col("loose") & F.coalesce(free, F.lit(False))))
    rank = F.struct((F.coalesce("si", F.lit(0.0)) + F.col("best")).alias("w"), F.col("type"))
    chosen = taken.groupBy(*spot).agg(F.max(rank)["type"].alias("pii_type")).drop("kind")
    mails = found.where(F.col("kind") == "email").select(*keys, "start_char", "end_char", F.lit("email").alias("pii_type"))
    every = chosen.select(*keys, "start_char", "end_char", "pii_type").unionByName(mails)
    # of overlapping mentions the one that starts first stays; a window holds the mentions of one text
    before = Window.partitionBy(*keys).orderBy("start_char", F.desc("end_char")).rowsBetween(Window.unboundedPreceding, -1)
    free_of = every.withColumn("_until", F.max("end_char").over(before)).where(F.col("_until").isNull() | (F.col("_until") <= F.col("start_char")))
    return free_of.select(*keys, "pii_type", "start_char", "end_char")


def redact(texts: DataFrame, keys: list[str], text: str, found: DataFrame) -> DataFrame:
    """``texts`` with every mention in ``found`` replaced by the placeholder of its type.

    ``keys`` must be unique in ``texts``.
    """
    per = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "pii_type"))).alias("_mentions"))
    names = F.create_map(*(F.lit(x) for pair in PLACEHOLDERS.items() for x in pair))
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"))
    per = per.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_mentions")
    same = [texts[k].eqNullSafe(per[f"_k{i}"]) for i, k in enumerate(keys)]
    joined = texts.join(per, reduce(Column.__and__, same), "left").drop(*(f"_k{i}" for i in range(len(keys))))

    def add(acc, m):
        kept = F.substring(F.col(text), acc["at"] + 1, m["start_char"] - acc["at"])
        return F.struct(F.concat(acc["t"], kept, names[m["pii_type"]]).alias("t"), m["end_char"].alias("at"))

    clean = F.aggregate("_mentions", start, add, lambda acc: F.concat(acc["t"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))))
    return joined.withColumn(text, F.coalesce(clean, F.col(text))).drop("_mentions")
