import os

import pytest

import __spark_entry__ as entry
from linecensus.plans.oracle import oracle_sql
from linecensus.plans.queries import queries
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_statement():
    assert set(queries()) == set(oracle_sql())
    assert set(queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", queries())
def test_query_equals_its_statement(spark, con, name):
    assert compare(spark, con, SF, queries()[name], oracle_sql()[name]) is None


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["name", "files", "lines", "code", "comments", "blanks", "bytes"]
    assert frame.count() == 12


def test_paths_of_unreadable_files_are_made_once(spark):
    from linecensus.plans.queries import _unreadable

    # Weights and reading go over a written manifest, not over the table again.
    assert not [f for f in _unreadable(spark, "/root/testdata/sf0.001").inputFiles() if "events.parquet" in f]
