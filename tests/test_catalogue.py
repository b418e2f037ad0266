"""Queries against DuckDB on the driver's smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int | float | Decimal):
        return None if math.isnan(value) else round(float(value), 4)
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted([tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()], key=str)
    assert got == want
