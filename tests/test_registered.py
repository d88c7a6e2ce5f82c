"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry_point
from proofs.check import connect, differences
from proofs.oracle import oracle_sql
from proofs.queries import queries

FOLDER = os.environ.get("CANVASS_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())
    assert set(queries()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, database, name):
    result = queries()[name](spark, FOLDER)
    assert differences(result, database, oracle_sql()[name]) == []


def test_entry_gives_the_stage_counts(spark):
    assert entry_point.entry(spark).columns == ["standid", "count", "visioid"]
