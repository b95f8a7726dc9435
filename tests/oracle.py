"""Compare a Spark result with what DuckDB returns on the same tables."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6g}" if value else "0"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_cell, value)) + "]"
    if hasattr(value, "is_finite"):
        return f"{float(value):.6g}" if value else "0"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, sql: str, sf_dir: str) -> str:
    """Empty if both sides have the same columns and rows, else what differs."""
    names, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = connect(sf_dir)
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {names} and {want_names}"
    if rows != want:
        a, b = set(rows) - set(want), set(want) - set(rows)
        return f"{len(rows)} and {len(want)} rows; only here {len(a)}: {list(a)[:3]}; only there {len(b)}: {list(b)[:3]}"
    return ""
