"""Holds a query's rows against DuckDB's, without order; columns by name."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def difference(df, db, sql: str) -> str:
    """Empty where both have the same columns and rows."""
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    more, less = got - want, want - got
    if more or less:
        return f"{sum(got.values())} rows, {sum(want.values())} wanted; {order}; only here {list(more)[:2]}; only there {list(less)[:2]}"
    return ""
