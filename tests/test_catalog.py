"""Every query against its SQL twin on the smallest tables."""

from __future__ import annotations

import importlib.util
import os

import duckdb
import pytest

from fleetlens.catalog import QUERIES, TWINS

SF = "/root/testdata/sf0.001"
_path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools", "check.py")
_spec = importlib.util.spec_from_file_location("check", _path)
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in check.TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    good, line = check.compare(spark, duck, name, SF)
    assert good, line


def test_names():
    assert set(TWINS) <= set(QUERIES)
    assert len(QUERIES) == 136


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 8 and {r["status"] for r in rows} <= {"optimal", "fallback"}
