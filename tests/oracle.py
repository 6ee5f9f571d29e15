"""Runs a query and its SQL and compares the rows."""

import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(map(_plain, value))
    return value


def same(frame, con, sql: str) -> None:
    columns = sorted(frame.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(repr([_plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    ours = sorted(repr([_plain(r[c]) for c in columns]) for r in frame.collect())
    assert ours == theirs
