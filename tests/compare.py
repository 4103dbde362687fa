"""A query's rows against its SQL's, as multisets, with numbers to nine digits."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    try:
        return float(f"{float(x):.9g}") if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_value(r[i]) for i in order) for r in rows], key=repr)


def duck(sql: str, sf: str = SF):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def assert_same(df, sql: str, sf: str = SF):
    names, rows = duck(sql, sf)
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, rows)
