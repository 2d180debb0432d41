"""Side-by-side comparison of a registered query and its SQL text in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES.split():
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("null",) if math.isnan(value) else ("float", round(value, 6) + 0.0)
    return (type(value).__name__, value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in data), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short account of the difference."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    right = cursor.fetchall()
    left = [tuple(x) for x in df.collect()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    if not left:
        return "no rows on either side"
    a, b = rows(df.columns, left), rows(names, right)
    different = [(x, y) for x, y in zip(a, b) if x != y]
    if different:
        return f"{len(different)} of {len(a)} rows differ, first {sorted(names)}: {different[0][0]} vs {different[0][1]}"
    return None
