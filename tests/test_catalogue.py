"""Every registered tick query: against DuckDB where there is SQL, else that it runs and is not empty."""

import warnings

import pytest

from tests.compare import assert_same
from tests.conftest import SF
from tickweave import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, name):
    assert_same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 15
