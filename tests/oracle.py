"""Holds a query against DuckDB over the same tables."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')").fetchall()
    return c


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    return repr(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(_plain, r)) for r in df.select(cols).collect())


def rows_of_sql(c, sql):
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    cols = sorted(names)
    at = [names.index(x) for x in cols]
    return cols, sorted(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
