"""Every registered query that has SQL, against DuckDB on whole tables."""

import os

import pytest

import __spark_entry__ as entries
from tests.oracle import compare
from uqframe.catalogue import registered

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registered()
WITH_SQL = [n for n, (_, sql) in QUERIES.items() if sql is not None]


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, name):
    query, sql = QUERIES[name]
    assert compare(spark, name, query, sql, SF) == ""


@pytest.mark.parametrize("name", ["forest_intervals", "quantile_forest", "local_conformal_experiments",
                                  "interval_modes"])
def test_intervals_cover(spark, name):
    """Nominal 90 % intervals on held-out rows."""
    for r in QUERIES[name][0](spark, SF).collect():
        assert 0.5 < r["coverage"] <= 1.0 and r["mean_width"] > 0


def test_entry(spark):
    assert entries.entry(spark).count() > 20
    assert set(entries.oracle_sql()) <= set(entries.queries())
