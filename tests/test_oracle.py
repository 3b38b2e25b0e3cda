"""Every registered query with a SQL twin against DuckDB on the smallest tables."""
import os

import pytest

import __spark_entry__ as entry
import check

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    msg, _, ok = check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, msg


def test_catalogue_names_are_unique_and_plain():
    from orbweave.plans import catalog
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    for n in catalog.QUERIES:
        assert n.isidentifier() and n == n.lower()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
