"""Compare a Spark result with the check SQL, independent of row and column order."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return f"{value:.6f}"
    if isinstance(value, int):
        return f"{float(value):.6f}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return str([canon(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple("\0" if v is None else v for v in r)
    return [columns[i] for i in order], sorted((tuple(canon(r[i]) for i in order) for r in rows), key=key)


def compare(df, con, sql):
    """Return '' when equal, else a short description of the first difference."""
    ours_cols, ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs_cols, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if ours_cols != theirs_cols:
        return f"columns {ours_cols} != {theirs_cols}"
    if ours == theirs:
        return ""
    a, b = set(ours), set(theirs)
    return (f"rows {len(ours)} vs {len(theirs)}; only ours {sorted(a - b, key=str)[:3]}; "
            f"only theirs {sorted(b - a, key=str)[:3]}")
