"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    if name not in oracle_sql():
        assert queries()[name](spark, FOLDER).count() >= 0
        return
    rows, diff = differences(spark, con, FOLDER, queries()[name], oracle_sql()[name])
    assert diff is None


def test_entry(spark):
    assert entry(spark).count() > 0
