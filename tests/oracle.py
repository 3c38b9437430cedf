"""Runs a query and its SQL on the same files and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return db


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if hasattr(value, "item"):
        return value.item()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value):
    return type(value).__name__ if value is not None else None


def compare(spark_df, db, sql: str) -> str | None:
    """None when rows, names and value types agree; else what differs."""
    cursor = db.cursor()
    cursor.execute(sql)
    names = [d[0] for d in cursor.description]
    want_rows = cursor.fetchall()
    got_rows = spark_df.collect()
    got_names = spark_df.columns
    if sorted(names) != sorted(got_names):
        return f"columns {sorted(got_names)} != {sorted(names)}"
    order = sorted(names)
    left = [got_names.index(n) for n in order]
    right = [names.index(n) for n in order]
    got = Counter(tuple(plain(r[i]) for i in left) for r in got_rows)
    want = Counter(tuple(plain(r[i]) for i in right) for r in want_rows)
    if got != want:
        only_got = list((got - want).elements())
        only_want = list((want - got).elements())
        return (
            f"rows {len(got_rows)} vs {len(want_rows)}; {len(only_got)} only in Spark, {len(only_want)} only in SQL\n"
            f"  {order}\n  spark {sorted(map(str, only_got))[:3]}\n  sql   {sorted(map(str, only_want))[:3]}"
        )
    for i, name in enumerate(order):
        a = {kind(r[i]) for r in got} - {None}
        b = {kind(r[i]) for r in want} - {None}
        if a != b:
            return f"column {name}: types {a} vs {b}"
    if not got_rows:
        return "no rows"
    return None
