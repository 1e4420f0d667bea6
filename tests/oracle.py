"""Compare a query with its DuckDB SQL on the same tables, without regard to row order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        path = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return x


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def compare(spark, sf, query, sql):
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf).execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    different = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not different, (len(different), different[:3])
    return len(got[1])
