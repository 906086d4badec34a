"""Compare registered queries with their SQL on the same parquet tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(con, sql: str, df) -> list[str]:
    """Differences between the SQL result and the frame, empty when equal."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    actual = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    a, b = _sorted_rows(df.columns, actual), _sorted_rows(names, expected)
    if len(a) != len(b):
        return [f"rows {len(a)} != {len(b)}"]
    return [f"{x} != {y}" for x, y in zip(a, b) if x != y or [type(v) for v in x] != [type(v) for v in y]][:3]
