"""Compares a query with its DuckDB twin on the driver's tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, int):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differs(df, sql: str, sf_dir: str) -> str:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} and {b} ({sorted(names)})"
    return ""
