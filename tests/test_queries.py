"""Every registered query against its DuckDB statement on the smallest driver tables."""

import decimal
import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from voxgauge.session import TABLES
from voxgauge.workload import all_checks, all_queries

SF = "/root/testdata/sf0.001"
CHECKS = all_checks()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in CHECKS:
        result = duck.execute(CHECKS[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
        assert got == want


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_a_check():
    assert set(CHECKS) == set(all_queries())


def test_the_driver_sees_every_query():
    assert set(all_queries()) <= set(queries())
    assert set(oracle_sql()) <= set(queries())
