"""Every registered query against its SQL, run by DuckDB in this process."""

import pytest
from compare import connect, duck_rows, spark_rows

import __spark_entry__ as entry_points
from hexloom.plans import registry

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir, duck):
    result = QUERIES[name](spark, sf_dir)
    assert spark_rows(result) == duck_rows(duck, ORACLES[name])
    types = {c[0]: str(c[1]) for c in duck.execute(ORACLES[name]).description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in result.schema} == types


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
