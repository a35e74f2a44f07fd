"""Side-by-side check of a registered query against its DuckDB oracle."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from tablesmith.queries.common import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) if digits is not None else v
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), digits)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return _norm(tuple(v), digits)
    if hasattr(v, "toArray"):
        return _norm([float(x) for x in v.toArray()], digits)
    return v


def rows_of(cols, rows, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        out.append(tuple(_norm(r[i], digits) for i in order))
    return sorted(out, key=repr), [cols[i] for i in order]


def compare(spark, con, name, fn, sql, sf_dir, digits=None):
    """Return (ok_exact, ok_tolerant, message)."""
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    if len(s_rows) != len(d_rows):
        return False, False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    a, _ = rows_of(s_cols, s_rows, None)
    b, _ = rows_of(d_cols, d_rows, None)
    if a == b:
        return True, True, "exact"
    a9, _ = rows_of(s_cols, s_rows, 9)
    b9, _ = rows_of(d_cols, d_rows, 9)
    diff = [(x, y) for x, y in zip(a9, b9) if x != y][:3]
    return False, a9 == b9, f"values differ (tolerant={a9 == b9}); first: {diff}"
