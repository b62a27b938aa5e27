"""Every query of the library against its DuckDB twin, and the driver's entry point."""

import pytest

import __spark_entry__
from larkspur.plans import catalog
from tests.oracle import differs

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, name):
    assert differs(QUERIES[name](spark, SF), SQL[name], SF) == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
