"""Spark queries against DuckDB SQL over the same Parquet tables, the way the driver does it."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, threads: int = 2) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute(f"set threads = {threads}")
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


def compare(spark, query, sql: str, sf_dir: str) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    mine, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, cur.fetchall())
    if mine == theirs:
        return None
    a, b = [r for r in mine if r not in set(theirs)][:3], [r for r in theirs if r not in set(mine)][:3]
    return f"{len(mine)} and {len(theirs)} rows; {a} and {b}"
