"""Side-by-side comparison of a Spark result and DuckDB's on the same tables."""

import os

import duckdb


def views(sf_dir: str):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        path = f"{sf_dir}/{t}"
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def tidy(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows], key=str)


def same(df, con, sql: str) -> None:
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert tidy(df.columns, [tuple(r) for r in df.collect()]) == tidy(rel.columns, rel.fetchall())
