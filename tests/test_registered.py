"""Every registered query against its SQL at the smallest scale; the others must return rows with unique columns."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
MAY_BE_EMPTY = {"baseline_risk", "early_risk"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    _, rows, problem = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert problem is None
    assert rows > 0 or name in MAY_BE_EMPTY
