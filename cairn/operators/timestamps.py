"""Mixed timestamp notations, precisions and zones to one UTC instant in microseconds.

Each value is reduced to a character-class mask (digits become ``9``, a run of letters ``A``).  Only
a handful of distinct masks occur however many rows there are; each is mapped to a parser once per
worker and all values that share it are converted together: regex groups into integer columns,
civil date to days, zone by binary search in a transition table (:mod:`cairn.functions.zones`).

Defined results: null, blank and unreadable values give null; impossible dates (month 13, day 0,
30 February) and an unknown zone name are unreadable; digits finer than a microsecond are cut off.
A value without a zone is local to the row's zone, or UTC where that is null or unknown.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cairn.functions import zones

#: Values of this form are already normal and are cast on the JVM side.
NORMAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"

_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm](?:\.|(?![A-Za-z])))?"
_ZONE = r"(?:\s*(?P<off>[Zz]|[+-]\d{2}(?::?\d{2})?)(?:\s*\[[^\]]*\])?|\s*\[(?P<br>[^\]]+)\]|\s*(?P<nm>[A-Za-z]+(?:[/_+\-][A-Za-z0-9]+)*))?"
_TAIL = rf"(?:(?:[Tt]|,?\s+|,?\s+at\s+){_TIME}{_ZONE})?$"

#: (mask of the date part, parser of the whole value).
_GRAMMARS = [
    (re.compile(r"9999([-/])99?\1"), re.compile(rf"^(?P<y>\d{{4}})([-/])(?P<mo>\d{{1,2}})\2(?P<d>\d{{1,2}}){_TAIL}")),
    (re.compile(r"99?\.99?\.9999"), re.compile(rf"^(?P<d>\d{{1,2}})\.(?P<mo>\d{{1,2}})\.(?P<y>\d{{4}}){_TAIL}")),
    (re.compile(r"99?/99?/9999"), re.compile(rf"^(?P<mo>\d{{1,2}})/(?P<d>\d{{1,2}})/(?P<y>\d{{4}}){_TAIL}")),
    (re.compile(r"(?:A,? +)?99? +A +9999"), re.compile(rf"^(?:[A-Za-z]+,?\s+)?(?P<d>\d{{1,2}})\s+(?P<mon>[A-Za-z]+)\s+(?P<y>\d{{4}}){_TAIL}")),
    (re.compile(r"(?:A,? +)?A +99?,? +9999"), re.compile(rf"^(?:[A-Za-z]+,?\s+)?(?P<mon>[A-Za-z]+)\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}){_TAIL}")),
    (re.compile(r"99999999A999999"), re.compile(rf"^(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})[Tt](?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})(?:\.(?P<f>\d+))?(?P<ap>(?!))?{_ZONE}$")),
]
_NUMBER = re.compile(r"^(-?)(\d{1,20})(?:\.(\d+))?$")
_NUMBER_MASK = re.compile(r"-?9+(?:\.9+)?$")
_WRAPPED = re.compile(r'^\{\s*"\$date"\s*:\s*(?:\{\s*"\$numberLong"\s*:\s*"?(-?\d+)"?\s*\}|(-?\d+)|"([^"{}]*)")\s*\}$')
_FIELDS = ("y", "mo", "mon", "d", "h", "mi", "s", "f", "ap", "off", "br", "nm")

_TO_MASK = {i: "9" if chr(i).isdigit() else "A" if chr(i).isalpha() else None for i in range(128)}
_TO_MASK = {i: c for i, c in _TO_MASK.items() if c}
_LETTERS = re.compile("A+")
_parsers: dict[str, re.Pattern | str | None] = {}


def mask(value: str) -> str:
    """The character-class mask of a value."""
    return _LETTERS.sub("A", value.translate(_TO_MASK))


def _parser(shape: str) -> re.Pattern | str | None:
    """The parser of a mask: a pattern, 'number', or None where no notation has this mask."""
    if shape not in _parsers:
        if len(_parsers) > 4096:  # masks of garbage must not pile up
            _parsers.clear()
        found = "number" if _NUMBER_MASK.match(shape) else None
        _parsers[shape] = found or next((p for m, p in _GRAMMARS if m.match(shape)), None)
    return _parsers[shape]


def _number_us(text: str, unit: int | None = None) -> int | None:
    """Microseconds of a bare number; ``unit`` is the power of ten of its fraction of a second."""
    if not (m := _NUMBER.match(text)):
        return None
    sign, whole, fraction = m.groups()
    if unit is None:
        digits = len(whole)
        unit = 0 if digits <= 11 else 3 if digits <= 14 else 6 if digits <= 17 else 9
    scaled = int(whole + (fraction or "").ljust(9, "0")[:9])  # units of 10^-9 of the number's unit
    us = scaled // 10 ** (unit + 3)
    return -us if sign else us


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 in the proleptic Gregorian calendar."""
    y = y - (m <= 2)
    era = np.floor_divide(y, 400)
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468


def _ints(values: list[str | None], default: int) -> np.ndarray:
    return np.array([int(v) if v is not None else default for v in values], dtype=np.int64)


def _offset_us(text: str) -> int:
    if text in "Zz":
        return 0
    digits = text[1:].replace(":", "").ljust(4, "0")
    minutes = int(digits[:2]) * 60 + int(digits[2:])
    return (-minutes if text[0] == "-" else minutes) * 60_000_000


def _convert(parser: re.Pattern, values: list[str], locals_: list[str | None]) -> list[int | None]:
    """All values of one mask at once."""
    matches = [parser.match(v) for v in values]
    rows = [i for i, m in enumerate(matches) if m]
    out: list[int | None] = [None] * len(values)
    if not rows:
        return out
    have = parser.groupindex
    col = {k: [matches[i].group(k) if k in have else None for i in rows] for k in _FIELDS}
    year, day = _ints(col["y"], 0), _ints(col["d"], 0)
    month = np.array([_MONTHS.get(v[:3].lower(), 0) for v in col["mon"]], dtype=np.int64) if "mon" in have else _ints(col["mo"], 0)
    hour, minute, second = _ints(col["h"], 0), _ints(col["mi"], 0), _ints(col["s"], 0)
    half = np.array([0 if v is None else 1 if v in "Aa" else 2 for v in col["ap"]])
    good = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (minute <= 59) & (second <= 59)
    good &= np.where(half > 0, (hour >= 1) & (hour <= 12), hour <= 23)
    hour = np.where(half > 0, hour % 12 + np.where(half == 2, 12, 0), hour)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.where(good, month, 0)]
    good &= day <= length + (leap & (month == 2))
    fraction = np.array([int(v[:6].ljust(6, "0")) if v else 0 for v in col["f"]], dtype=np.int64)
    local = ((_days(year, month, day) * 24 + hour) * 60 + minute) * 60 + second
    local = local * 1_000_000 + fraction
    where: dict[str | int, list[int]] = {}
    for k, i in enumerate(rows):
        if col["off"][k]:
            zone: str | int = _offset_us(col["off"][k])
        elif name := col["br"][k] or col["nm"][k]:
            zone = zones.ABBREVIATIONS[name.upper()] * 60_000_000 if name.upper() in zones.ABBREVIATIONS else name
        else:
            zone = locals_[i] if locals_[i] and zones.transitions(locals_[i]) is not None else 0
        where.setdefault(zone, []).append(k)
    utc = np.zeros(len(rows), dtype=np.int64)
    for zone, ks in where.items():
        at = np.array(ks)
        moved = local[at] - zone if isinstance(zone, int) else zones.local_to_utc(local[at], zone)
        if moved is None:
            good[at] = False
        else:
            utc[at] = moved
    for k, i in enumerate(rows):
        if good[k]:
            out[i] = int(utc[k])
    return out


def parse_batch(values: list[str | None], locals_: list[str | None]) -> list[int | None]:
    """UTC microseconds of a batch of values with their rows' zones."""
    out: list[int | None] = [None] * len(values)
    groups: dict[str, list[int]] = {}
    texts: list[str] = [""] * len(values)
    for i, v in enumerate(values):
        if v is None or not (v := v.strip()):
            continue
        v = v.replace("\u202f", " ").replace("\u00a0", " ")
        if v[0] == "{":
            if not (m := _WRAPPED.match(v)):
                continue
            if (number := m[1] or m[2]) is not None:
                out[i] = _number_us(number, 3)
                continue
            v = m[3].strip()
        texts[i] = v
        groups.setdefault(mask(v), []).append(i)
    for shape, rows in groups.items():
        parser = _parser(shape)
        if parser is None:
            continue
        if parser == "number":
            done = [_number_us(texts[i]) for i in rows]
        else:
            done = _convert(parser, [texts[i] for i in rows], [locals_[i] for i in rows])
        for i, us in zip(rows, done):
            out[i] = us if us is not None and -(2**63) < us < 2**63 else None
    return out


def _udf(version: str):
    @F.pandas_udf(LongType())
    def to_utc(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if zones.database_version() != version:
            raise RuntimeError(f"time zone database {zones.database_version()} here, {version} at the driver")
        for value, zone in batches:
            zone = zone.astype(object).where(zone.notna(), None)
            value = value.astype(object).where(value.notna(), None)
            yield pd.Series(parse_batch(value.tolist(), zone.tolist()), dtype="Int64")

    # else a filter on the result is pushed below and evaluates the function a second time
    return to_utc.asNondeterministic()


def utc_micros(value: Column, zone: Column) -> Column:
    """``value`` as microseconds since 1970-01-01 UTC (null where unreadable), for any notation."""
    return _udf(zones.database_version())(value, zone)


def instant(value: Column) -> Column:
    """Microseconds of the two machine notations (ISO with offset, wrapped milliseconds), else null.

    For columns known to hold little else; it never leaves the JVM.
    """
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"), value)
    millis = F.regexp_extract(value, r'^\{"\$date":\{"\$numberLong":"(-?\d{1,15})"\}\}$', 1)
    return F.coalesce(F.unix_micros(F.try_to_timestamp(iso)), F.when(millis != "", millis.try_cast("long") * 1000))


def normalise(df: DataFrame, value: str, zone: str | None = None, to: str = "utc_us") -> DataFrame:
    """Add ``to``: the UTC instant of column ``value``, in microseconds.

    Normal values are converted by the JVM's own cast; only the others visit Python.  An existing
    column named ``to`` is replaced.
    """
    local = F.col(zone) if zone else F.lit(None).cast("string")
    normal = F.col(value).rlike(NORMAL)
    quick = F.unix_micros(F.try_to_timestamp(F.when(normal, F.col(value))))
    slow = utc_micros(F.when(~F.coalesce(normal, F.lit(False)), F.col(value)), local)
    return df.withColumn(to, F.coalesce(quick, slow))
