"""Run a query's SQL in DuckDB and compare rows without regard to order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows_of(records, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in records), key=lambda x: tuple((y is not None, str(y)) for y in x))


def check(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if path.is_file() else f'{path}/*.parquet'}')")
    got = query(spark, sf_dir)
    want = con.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    found = rows_of(got.collect(), columns)
    assert found == rows_of([dict(zip(want.columns, r)) for r in want.fetchall()], columns)
    return found
