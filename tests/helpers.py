"""Comparison of a query with its SQL."""

import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        at = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con


def canonical(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


def assert_same(spark, con, folder, query, sql):
    ours, theirs = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    a, b = canonical(ours, columns), canonical(theirs, columns)
    assert a == b, (sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3])
