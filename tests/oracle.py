"""Compares a query with its DuckDB SQL, as the driver does."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, list):
        return [plain(y) for y in x]
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr([plain(r[i]) for i in order]) for r in data)


def compare(df, con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = rows(names, got.fetchall())
    have = rows(df.columns, [list(r) for r in df.collect()])
    assert have[0] == want[0], (have[0], want[0])
    assert len(have[1]) == len(want[1]), (len(have[1]), len(want[1]))
    bad = [(a, b) for a, b in zip(have[1], want[1]) if a != b]
    assert not bad, bad[:3]
