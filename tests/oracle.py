"""Runs a query and its SQL over the same tables and compares the rows."""

import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value.item() if hasattr(value, "item") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r]
    return [columns[i] for i in order], sorted(([_plain(r[i]) for i in order] for r in rows), key=key)


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1]), (len(mine[1]), len(theirs[1]))
    bad = [(a, b) for a, b in zip(mine[1], theirs[1], strict=True) if a != b]
    assert not bad, (len(bad), bad[:3])
    return len(mine[1])
