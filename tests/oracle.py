"""Compare a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return repr(v)


def rows(columns, data, wanted):
    at = [list(columns).index(c) for c in wanted]
    return sorted(tuple(value(r[i]) for i in at) for r in data)


def assert_equal(df, con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    wanted = sorted(names)
    got, want = rows(df.columns, df.collect(), wanted), rows(names, result.fetchall(), wanted)
    assert len(got) == len(want)
    assert got == want
