"""Rows of a DataFrame against those of DuckDB SQL over the same Parquet tables."""

import math
import os

import duckdb

#: Rows are compared at this size in the tests.
SF = "/root/testdata/sf0.001"


def connected(sf_dir=SF):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in data])


def same(df, sql, sf_dir=SF):
    got = df.collect()
    with connected(sf_dir) as c:
        want = c.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
