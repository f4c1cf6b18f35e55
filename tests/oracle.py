"""Rows of a registered query and of its DuckDB oracle, compared exactly (floats to 1e-9 relative)."""

import datetime as dt
import decimal
import math
import os

import duckdb

from equiflow.sources.tables import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    key = lambda row: tuple((v is not None, str(type(v)) if not isinstance(v, (int, float)) else "", f"{v:.6e}" if isinstance(v, float) else str(v)) for v in row)
    return sorted(cols), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) <= 1e-9 * max(abs(a), abs(b), 1.0))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def assert_equal(df, con, sql):
    got_cols, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert got_cols == want_cols
    assert len(got) == len(want) > 0
    wrong = [(x, y) for x, y in zip(got, want) if not same(x, y)]
    assert not wrong, wrong[:3]
