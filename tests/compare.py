"""Run a registered query on both engines and compare all rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{path}'")
    return con


def norm(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def spark_rows(df):
    names = sorted(df.columns)
    quoted = [f"`{n}`" for n in names]
    return names, sorted([tuple(norm(v) for v in r) for r in df.select(*quoted).collect()], key=key)


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    return [cols[i] for i in order], sorted(rows, key=key), {d[0]: str(d[1]) for d in cur.description}
