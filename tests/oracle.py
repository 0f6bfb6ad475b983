"""Runs a query in Spark and its SQL in DuckDB and holds the rows against each other."""

import os

import duckdb


def tables(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return con


def plain(value):
    if isinstance(value, float) or hasattr(value, "quantize"):
        return f"{float(value):.6f}"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return repr(value)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(map(str, (plain(r[i]) for i in order))) for r in rows)


def agree(spark, folder, query, sql, con):
    df = query(spark, folder)
    got = rows_of(df.collect(), df.columns)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    wanted = rows_of(result.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns)
    assert got == wanted
    return got
