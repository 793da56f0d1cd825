"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from corvane.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return connection


def plain(value):
    return (None if math.isnan(value) else round(value, 9) + 0.0) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall()]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str) == sorted(want, key=str)


def test_entry_points(spark):
    assert set(registry.ORACLES) == set(registry.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 10
