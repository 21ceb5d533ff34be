"""Every registered query with SQL, against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from hearthlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        connection.sql(f"CREATE VIEW {t} AS FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def cell(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def normalised(rows, columns, order):
    return sorted(tuple(cell(r[columns.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    wanted = duck.sql(registry.ORACLES[name])
    order = sorted(found.columns)
    assert order == sorted(wanted.columns)
    assert normalised(found.collect(), found.columns, order) == normalised(wanted.fetchall(), wanted.columns, order)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
