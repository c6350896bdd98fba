"""Every registered query of the engine against its SQL in DuckDB, by columns, types and rows."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from zephyrine import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same(name, spark, sf, duck):
    df = queries.queries()[name](spark, sf)
    found = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    order = sorted(columns)
    assert sorted(df.columns) == order
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=str)
    assert got == want
    kinds = dict(df.dtypes)
    said = {d[0]: str(d[1]) for d in found.description}
    assert {c: TYPES.get(kinds[c], kinds[c]) for c in order} == said


def test_every_sql_has_a_query():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert set(queries.queries()) - set(queries.oracle_sql()) == {"jwt"}
