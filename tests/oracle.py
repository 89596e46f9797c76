"""Compares a Spark result with DuckDB's, as sets of rows with doubles rounded to nine digits."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(rows):
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr([clean(v) for v in row]) for row in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(df, sql, sf_dir):
    columns = sorted(df.columns)
    got = rows_of(tuple(r) for r in df.select(*columns).collect())
    found = duck(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = rows_of(tuple(row[names.index(c)] for c in columns) for row in found.fetchall())
    assert got == want
