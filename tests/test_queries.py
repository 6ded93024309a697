"""Every registered query agrees with its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert queries()[name](spark, SF_DIR).count() > 0
    else:
        assert differences(spark, con, queries()[name], sql, SF_DIR) == []


def test_entry(spark):
    assert entry(spark).count() == 1
