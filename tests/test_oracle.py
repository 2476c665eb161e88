"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as driver
from tests.check import compare, oracle
from tideline.plans import all_oracles, all_queries


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle(sf_dir)


def test_every_query_has_its_sql():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(name, spark, connection, sf_dir):
    sql = all_oracles()[name]
    assert compare(spark, connection, sf_dir, name, all_queries()[name], sql) == []


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert [str(r["day"]) for r in rows] == ["2001-06-30", "2001-07-01", "2001-07-02"]
