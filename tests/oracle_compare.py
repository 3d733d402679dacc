"""Run a catalog query on Spark and its SQL on DuckDB; compare rows, column names and values."""

from __future__ import annotations

import datetime as dt
import decimal

import duckdb

VIEWS = ("region nation customer supplier part orders lineitem events documents embeddings "
         "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for v in VIEWS:
        con.execute(f"create view {v} as select * from read_parquet('{sf_dir}/{v}.parquet')")
    return con


def _norm(v):
    """Exact: decimals by their text, doubles by repr (no rounding tolerance)."""
    if v is None:
        return None
    if isinstance(v, float):
        return ("f", repr(v))
    if isinstance(v, decimal.Decimal):
        return ("d", str(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    s_names = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_names = [d[0] for d in res.description]
    d_rows = res.fetchall()
    if sorted(s_names) != sorted(d_names):
        return False, f"columns differ: spark={sorted(s_names)} duckdb={sorted(d_names)}"
    if len(s_rows) != len(d_rows):
        return False, f"row count differs: spark={len(s_rows)} duckdb={len(d_rows)}"
    a, b = _rows(s_names, s_rows), _rows(d_names, d_rows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ, first: {diff}"
    return True, f"{len(s_rows)} rows"
