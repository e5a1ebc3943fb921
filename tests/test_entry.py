"""Every registered query against its SQL counterpart in DuckDB, and the shape of its plan."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tallyfield.sources import star

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in star.TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def _sorted(rows):
    def plain(value):
        return None if isinstance(value, float) and math.isnan(value) else value

    rows = [tuple(plain(v) for v in row) for row in rows]
    return sorted(rows, key=lambda row: [(v is not None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(entry.core_queries()))
def test_equals_sql(spark, duck, name):
    mine = entry.core_queries()[name](spark, FOLDER)
    sql = duck.sql(entry.core_oracle_sql()[name])
    columns = sorted(mine.columns)
    assert columns == sorted(sql.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = sql.project(quoted).fetchall()
    found = mine.select(*[f"`{c}`" for c in columns]).collect()
    assert _sorted(found) == _sorted(expected)


def test_every_query_has_sql():
    assert set(entry.core_queries()) == set(entry.core_oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.core_queries()))
def test_plans(spark, name):
    plan = entry.core_queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ["CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas"]:
        assert unwanted not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
