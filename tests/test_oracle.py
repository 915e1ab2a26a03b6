"""Spark queries vs their DuckDB oracle on the driver tables (sf0.001 by default).

``tests/oracle_compare.py`` does the same as a script, at any scale factor.
"""

import os

import pytest

import __spark_entry__ as entry
from weft.catalog import QUERIES, SQL
from tests.oracle_compare import compare, duck

KEYS = sorted(SQL)
SF_DIR = os.environ.get("WEFT_ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    r = compare(spark, con, key, QUERIES[key], SQL[key], SF_DIR)
    assert r["ok"], r


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["community", "size", "rejected", "passed_overdue"]
    assert df.count() > 0
