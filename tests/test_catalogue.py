"""Every registered query beside its SQL, on the smallest test data."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry(spark):
    assert entry(spark).count() == 6


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    rows = queries()[name](spark, SF_DIR).toPandas()
    assert len(rows)
    if name in oracle_sql():
        assert difference(rows, con.execute(oracle_sql()[name]).df()) == ""
