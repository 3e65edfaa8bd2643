"""Every query against its SQL, on the smallest test tables (or those in $TEST_SF_DIR)."""

import os
import re

import pytest

import __spark_entry__ as entry
from tests.compare import check

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, name):
    ok, note = check(spark, SF_DIR, name)
    assert ok, note


def test_every_query_has_sql():
    """But for operators on training data that SQL cannot express; those have tests of their own."""
    beyond = {name for name in entry.queries() if name == "pipeline" or re.match(r"op\d+_", name)}
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.queries().keys() - beyond <= entry.oracle_sql().keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
