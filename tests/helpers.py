"""Comparison of a Spark frame with the rows that DuckDB gives for a SQL text."""

import datetime
import decimal
import math
import os

import duckdb


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def assert_same(df, sql, sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}/*.parquet" if os.path.isdir(f"{sf}/{name}") else f"{sf}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    want = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})").fetchall()
    got = df.select(*columns).collect()
    assert sorted(repr(tuple(map(value, r))) for r in got) == sorted(repr(tuple(map(value, r))) for r in rows)
