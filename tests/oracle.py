"""Comparing a query with its SQL counterpart."""

import datetime
import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def connect(directory):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(directory).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def same(frame, con, sql):
    columns = sorted(frame.columns)
    left = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    right = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())
    assert left == right
