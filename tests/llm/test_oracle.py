"""Each numbered query with SQL against DuckDB on the same tables."""

import duckdb
import pytest

from tests.oracle_compare import compare
from weft.llm.queries import QUERIES
from weft.llm.sql import SQL

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], SQL[name], SF_DIR)
    assert r["ok"], r


def test_numbered_queries_are_all_there():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES if k != "pipeline") == list(range(1, 14)) and "pipeline" in QUERIES
