"""Comparison of a query's rows with DuckDB's on the same tables."""

import math

import duckdb

from lattice.catalog import TABLES


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.9g}")
    return str(v) if hasattr(v, "isoformat") else v


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = sorted(repr([plain(row[names.index(c)]) for c in order]) for row in result.fetchall())
    found = sorted(repr([plain(row[c]) for c in order]) for row in df.collect())
    assert found == expected
