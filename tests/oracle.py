"""Comparison of a query with its SQL."""

import glob
import math
import os

import duckdb


def connect(folder):
    """A database with a view of each table."""
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    """A value as it compares."""
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def compare(df, con, sql):
    """Assert that both give the same columns and rows."""
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    got = df.select(*cols).collect()
    norm = lambda rows: sorted(repr(tuple(plain(x) for x in r)) for r in rows)
    assert norm(got) == norm(want)
    return len(want)
