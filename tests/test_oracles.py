"""Queries of records, planes, samples and tiles against their SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from cubewright.plans import record_queries  # noqa: F401
from cubewright.plans.queries import SQL, Q

NAMES = [n for n, f in Q.items() if f.__module__ == record_queries.__name__ and n in SQL]


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, sf, tables, name):
    df = Q[name](spark, sf)
    names = sorted(df.columns)
    cursor = tables.execute(SQL[name])
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    assert names == sorted(at)
    want = sorted(repr([plain(r[at[c]]) for c in names]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == want
