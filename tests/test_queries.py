"""Every query of the plans against its DuckDB twin at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.functions import catalog
from sparkloom.plans import code_queries, profile_queries, source_queries
from sparkloom.plans import queries as plans

QUERIES = {**plans.QUERIES, **code_queries.QUERIES, **profile_queries.QUERIES, **source_queries.QUERIES}
ORACLES = {**plans.oracle_sql(), **code_queries.oracle_sql(), **profile_queries.oracle_sql(), **source_queries.oracle_sql()}

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_every_rule_has_hits(duck):
    found = {r[0] for r in duck.execute(f"SELECT DISTINCT rule FROM ({ORACLES['rule_findings_code']})").fetchall()}
    assert found == {r[0] for r in catalog.RULES}
    found = {r[0] for name in ("count_findings_code", "block_findings_code", "unknown_imports_code") for r in duck.execute(f"SELECT DISTINCT rule FROM ({ORACLES[name]})").fetchall()}
    assert found == {"high_todo_density", "typescript_as_density", "rust_refcell_overuse", "php_missing_strict_types", "long_function", "excessive_docstring", "unknown_dependency_import"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(map(repr, x[columns].astype(object).itertuples(index=False, name=None))) for x in (got, want)]
    assert rows[0] == rows[1]


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "line", "snippet", "ordinal"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
