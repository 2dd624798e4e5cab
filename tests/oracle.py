"""Run a query in Spark and its SQL in DuckDB and compare rows, columns by name."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (Decimal, int)) and not isinstance(x, bool):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def connection(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def compare(spark, query, sql: str, sf_dir: str) -> tuple[int, list]:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    out = connection(sf_dir).execute(sql)
    have = [d[0] for d in out.description]
    assert sorted(have) == names, (sorted(have), names)
    want = sorted((tuple(plain(r[have.index(n)]) for n in names) for r in out.fetchall()), key=str)
    return len(want), [x for x in zip(got, want, strict=False) if x[0] != x[1]][:2] + ([(len(got), len(want))] if len(got) != len(want) else [])
