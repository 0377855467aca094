"""Rows of a DuckDB statement over the tables of a folder."""

import duckdb

TABLES = "documents pages benchmark labels conversations".split()


def rows_of(sql, folder, **frames):
    con = duckdb.connect()
    for t in TABLES:
        if t in frames:
            con.register(t, frames[t])
        else:
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = con.sql(sql)
    return sorted((dict(zip(got.columns, r, strict=True)) for r in got.fetchall()), key=str)


def sorted_rows(df, columns):
    return sorted(({c: r[c] for c in columns} for r in df.collect()), key=str)
