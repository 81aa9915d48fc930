"""Compares a query with its SQL in DuckDB, row by row."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def assert_same(spark, folder, query, sql, con=None):
    con = con or connect(folder)
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*[f"`{n}`" for n in names]).collect())
    cols = ", ".join(f'"{n}"' for n in names)
    want = sorted(map(repr, con.sql(f"select {cols} from ({sql})").fetchall()))
    assert sorted(con.sql(sql).columns) == names
    assert got == want
