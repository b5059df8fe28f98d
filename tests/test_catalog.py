"""Every registered query against DuckDB on the driver's tables."""

import os

import pytest
from parity import compare, duck

from roadlake.queries import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"
CATALOG = catalog()
CHECKED = sorted(n for n, q in CATALOG.items() if q[1])


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, name):
    fn, sql = CATALOG[name]
    verdict = compare(spark, name, fn, sql, SF_DIR, con)
    if verdict.endswith("EMPTY"):  # the smallest tables have no trips or windows long enough for some
        verdict = compare(spark, name, fn, sql, LARGER, duck(LARGER))
    assert ": ok" in verdict, verdict


@pytest.mark.parametrize("name", sorted(n for n, q in CATALOG.items() if not q[1]))
def test_runs(spark, name):
    assert CATALOG[name][0](spark, SF_DIR).columns


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
