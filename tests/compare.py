"""Compares a Spark result with DuckDB's."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6) + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19].replace(" ", "T").removesuffix("T00:00:00")
    return x


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs, or nothing."""
    found = con.execute(sql)
    names = sorted(d[0] for d in found.description)
    if names != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {names}"
    kinds = {d[0]: str(d[1]) for d in found.description}
    apart = {n: (k, kinds[n]) for n, k in df.dtypes if KINDS.get(k, k) != kinds[n]}
    where = {d[0]: i for i, d in enumerate(found.description)}
    theirs = Counter(tuple(plain(row[where[n]]) for n in names) for row in found.fetchall())
    ours = Counter(tuple(plain(row[n]) for n in names) for row in df.select(*names).collect())
    if ours != theirs:
        more, less = ours - theirs, theirs - ours
        return f"{ours.total()} rows against {theirs.total()}; only Spark {more.total()}: {list(more.items())[:2]}; only DuckDB {less.total()}: {list(less.items())[:2]}"
    if not ours:
        return "no rows on either side"
    return f"types {apart}" if apart else ""
