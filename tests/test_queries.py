"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import workload
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(workload.QUERIES) == set(workload.ORACLE)


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query(spark, con, name):
    # at this size a filter may leave nothing, which is no fault by itself
    problems = [p for p in compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) if p != "no rows"]
    assert not problems, problems


def test_entry(spark):
    assert entry.entry(spark).count() > 0
