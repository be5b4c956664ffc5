"""Helpers to compare a Spark result with a DuckDB oracle result
(order-insensitive, columns matched by name, floats to 6 places)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

TEST_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TEST_TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    scols = spark_df.columns
    srows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    if sorted(scols) != sorted(dcols):
        return False, f"columns differ: {scols} vs {dcols}"
    if len(srows) != len(drows):
        return False, f"row counts differ: {len(srows)} vs {len(drows)}"
    a, b = canon(srows, scols), canon(drows, dcols)
    if a != b:
        return False, f"values differ: spark-only {[r for r in a if r not in b][:3]} " \
                      f"duck-only {[r for r in b if r not in a][:3]}"
    return True, f"{len(srows)} rows"
