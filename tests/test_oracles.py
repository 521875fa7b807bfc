"""Every registered query against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as entry_points
from check import compare, connect
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", entry_points.oracle_sql())
def test_equals_sql(spark, con, name):
    assert compare(spark, con, name, SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(entry_points.oracle_sql())))
def test_runs(spark, name):
    assert entry_points.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).columns[-1] == "snapshot_num"
