"""Every registered query against its SQL twin on the small tables."""
import os

import pytest

import __spark_entry__ as entry
from tests.compare import assert_same

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_sql(spark, key):
    assert_same(QUERIES[key](spark, FOLDER), ORACLES[key], FOLDER)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, key):
    assert QUERIES[key](spark, FOLDER).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
