"""Runs a query and its DuckDB text over one folder and compares rows, order aside."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        if p.exists():
            c.sql(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else 0.0 if v == 0 else v
    return v


def compare(spark, query, sql, folder):
    c = connect(folder)
    rel = c.sql(sql)
    df = query(spark, folder)
    names = sorted(df.columns)
    assert names == sorted(rel.columns), (names, sorted(rel.columns))
    at = [df.columns.index(n) for n in names]
    got = sorted((tuple(plain(r[i]) for i in at) for r in df.collect()), key=repr)
    at = [rel.columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    diff = next(((a, b) for a, b in zip(got, want) if a != b), None)
    assert len(got) == len(want) and diff is None, (len(got), len(want), diff, set(got) ^ set(want) if len(got) < 50 else None)
    return len(got)
