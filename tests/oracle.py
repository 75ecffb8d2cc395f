"""Compare a query with its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(spark, name, folder, entry):
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    return columns, sorted((tuple(repr(r[c]) for c in columns) for r in df.collect()))


def oracle_rows(name, folder, entry):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in got.fetchall())


def check(spark, name, folder, entry):
    assert rows_of(spark, name, folder, entry) == oracle_rows(name, folder, entry)
