"""Compare registered queries with their SQL over one set of tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows(names: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def differences(df, con, sql: str) -> list:
    """[] if columns and rows agree, else what differs."""
    got = con.sql(sql)
    if sorted(df.columns) != sorted(got.columns):
        return [("columns", sorted(df.columns), sorted(got.columns))]
    a, b = rows(df.columns, df.collect()), rows(got.columns, got.fetchall())
    if a == b:
        return []
    in_a, in_b = set(a), set(b)
    only_a, only_b = [x for x in a if x not in in_b][:3], [x for x in b if x not in in_a][:3]
    return [("rows", len(a), len(b)), *zip(only_a, only_b, strict=False)] if only_a or only_b else [("repeats", len(a), len(b))]
