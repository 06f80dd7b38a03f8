"""Compare a query's rows with those of its SQL in DuckDB."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def assert_same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    result = connect(sf_dir).execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    assert mine == theirs
