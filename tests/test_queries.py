"""Every registered query with an SQL form, against DuckDB on the smallest tables."""

import os

import pytest

import oracle
from pulsegrid.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, SF), ORACLES[name], SF) == ""


@needs_tables
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_with_unique_columns(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


@needs_tables
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
