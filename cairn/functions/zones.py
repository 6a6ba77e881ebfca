"""Zone transition tables, pinned to one version of the time zone database.

A table lists, for one zone, every change of its UTC offset between two years.  It is derived by
probing the installed database on a grid and bisecting each change, so it needs no knowledge of the
file format, and it holds a few hundred entries for any zone.
"""

from __future__ import annotations

import functools
import hashlib
from datetime import datetime, timedelta, timezone
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import numpy as np

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_FIRST_YEAR, _LAST_YEAR = 1900, 2100
_GRID = timedelta(days=20)

# Abbreviations that name one offset, in minutes east of UTC.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0,
    "BST": 60, "CET": 60, "WEST": 60, "CEST": 120, "EET": 120, "SAST": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EDT": -240, "AST": -240, "ADT": -180, "EST": -300, "CDT": -300, "CST": -360, "MDT": -360,
    "MST": -420, "PDT": -420, "PST": -480, "AKDT": -480, "AKST": -540, "HST": -600,
}


@functools.cache
def database_version() -> str:
    """The version of the time zone database that this Python process uses."""
    for root in TZPATH:
        for name, pick in (("+VERSION", lambda s: s), ("tzdata.zi", lambda s: s.split()[2] if s.startswith("# version") else "")):
            path = Path(root, name)
            if path.is_file():
                with path.open() as lines:
                    if version := pick(lines.readline().strip()):
                        return version
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:  # a database without a version is known by its contents
        digest = hashlib.sha256()
        for name in sorted(available_timezones()):
            for root in TZPATH:
                if (path := Path(root, name)).is_file():
                    digest.update(name.encode() + path.read_bytes())
                    break
        return digest.hexdigest()


def _offset(zone: ZoneInfo, seconds: int) -> int:
    moment = (_EPOCH + timedelta(seconds=seconds)).astimezone(zone)
    return int(moment.utcoffset().total_seconds())


@functools.cache
def transitions(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """``(until, offsets)`` of a zone in microseconds, or None for an unknown name.

    ``offsets[i]`` holds for local times below ``until[i]`` and not below ``until[i - 1]``.  Local
    times that occur twice, and those the clock skips, fall before ``until`` of the change, so both
    take the offset in force before it.
    """
    try:
        zone = ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None
    at = int((datetime(_FIRST_YEAR, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    end = int((datetime(_LAST_YEAR, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    step = int(_GRID.total_seconds())
    now = _offset(zone, at)
    until, offsets = [], [now]
    while at < end:
        later = at + step
        if (then := _offset(zone, later)) != now:
            low, high = at, later
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if _offset(zone, middle) == now else (low, middle)
            then = _offset(zone, high)
            until.append(high + max(now, then))
            offsets.append(then)
            now, at = then, high
        else:
            at = later
    return np.array(until, dtype=np.int64) * 1_000_000, np.array(offsets, dtype=np.int64) * 1_000_000


def local_to_utc(local_us: np.ndarray, zone: str) -> np.ndarray | None:
    """UTC microseconds of local civil microseconds in ``zone``; None if the zone is unknown."""
    table = transitions(zone)
    if table is None:
        return None
    until, offsets = table
    return local_us - offsets[np.searchsorted(until, local_us, side="right")]
