"""Every query with SQL, over the smallest tables: Spark beside DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import compare, tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    tables(c, FOLDER)
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    """Results equal those of the SQL; a query without SQL is only run here, its operator has tests of its own."""
    assert compare(spark, con, FOLDER, name).startswith("ok" if name in entry.oracle_sql() else "no SQL")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
