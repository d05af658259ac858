"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest
from compare import difference, sql_result

import __spark_entry__ as driver
from workload import oracle
from workload.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not here")


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle.build())
    assert set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = driver.queries()[name](spark, SF_DIR).toPandas()
    assert len(got)
    assert difference(got, sql_result(driver.oracle_sql()[name], SF_DIR)) is None


def test_entry(spark):
    assert driver.entry(spark).columns[:3] == ["TIMEDELTA", "TIMESTAMP", "HOSTNAME"]
