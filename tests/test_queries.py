"""Every query with SQL agrees with it."""

import pytest

import __spark_entry__ as entry
from tidewatch.plans import registry

from .conftest import SF, rows_of


@pytest.fixture(scope="module")
def connection(duck):
    return duck()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, connection, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = connection.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
