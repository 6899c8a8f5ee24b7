"""Every registered query against its SQL twin at the smallest scale."""

import os

import pytest
from compare import database, difference

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not here")
# Operators of the llm subpackage have their own tests.
OWN = {name for name in entry.queries() if name not in entry.oracles.sql()}


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - OWN))
def test_query(spark, con, name):
    assert difference(con, entry.queries()[name](spark, FOLDER), entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracles.sql()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
