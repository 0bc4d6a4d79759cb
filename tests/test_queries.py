"""Every query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from gleaner.plans import registry
from tools.verify import TABLES, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), db.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_pushdown_and_pruning(spark):
    plan = registry.QUERIES["incremental_cached_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id)" in plan and "n_chars" not in plan and "toxic" not in plan
