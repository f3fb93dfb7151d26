"""Compares a query's rows with DuckDB's."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql)


def _cell(x):
    if x is None or x != x:
        return "none"
    if isinstance(x, str):
        return x
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return repr(round(float(x), 6)) if not isinstance(x, (list, tuple)) else str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_cell(r[i]) for i in order) for r in values)


def same(df, sql: str, sf_dir: str) -> None:
    want = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
