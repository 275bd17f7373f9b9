"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import pytest

from parley import plans
from parley.plans.check import compare, connect


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query_matches_sql(spark, duck, sf, name):
    assert compare(spark, duck, name, sf) == ""


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracles())


def test_entry(spark):
    import __spark_entry__ as driver

    rows = driver.entry(spark)
    assert rows.count() > 0
    assert {"text", "split", "answer_type"} <= set(rows.columns)
    assert set(driver.oracle_sql()) <= set(driver.queries())
