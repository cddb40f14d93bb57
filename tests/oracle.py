"""Compares a query with its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql, c):
    """Rows that only one side has."""
    out = c.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    want, got = normal(out.fetchall(), names), normal([tuple(r) for r in df.collect()], df.columns)
    return [(a, b) for a, b in zip(want, got, strict=False) if a != b] + ([(len(want), len(got))] if len(want) != len(got) else [])
