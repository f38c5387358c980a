"""Runs a query and its DuckDB SQL over the same tables and compares all rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def rows(columns: list[str], records) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in records)


def assert_same(spark, con, run, sql: str, sf_dir: str) -> None:
    df = run(spark, sf_dir)
    made = con.sql(sql)
    assert sorted(df.columns) == sorted(made.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(made.columns, made.fetchall())
