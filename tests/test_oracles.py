"""Every registered query against its DuckDB counterpart, on the smallest tables."""

import pytest

import __spark_entry__ as entry

from .compare import difference, duckdb_on
from .conftest import DATA

FOLDER = f"{DATA}/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duckdb_on(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    frame = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert difference(frame, connection, ORACLES[name]) is None
    else:
        assert frame.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    frame = entry.entry(spark)
    assert len(frame.columns) == 6 and frame.count() == 1
