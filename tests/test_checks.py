"""Every registered query against its SQL in the checking engine."""

import duckdb
import pytest

import __spark_entry__ as entries
from tanadex.plans.registry import CHECKS, QUERIES
from tests.check_tool import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(entries.queries()) and set(CHECKS) <= set(entries.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict = compare(spark, con, FOLDER, name, QUERIES[name], CHECKS[name])
    assert verdict.startswith("ok ") and verdict != "ok but empty", verdict


@pytest.mark.parametrize("name", ["search_exact_narrow", "search_all"])
def test_queries_for_all(spark, tmp_path, name):
    """Part names that ask for everything when they are searched for: each such query has the rows that the SQL gives it."""
    con = duckdb.connect()
    part = f"SELECT * REPLACE (CASE p_partkey WHEN 2 THEN ' *' WHEN 5 THEN '* ' WHEN 8 THEN '*' ELSE p_name END AS p_name) FROM '{FOLDER}/part.parquet'"
    con.execute(f"COPY ({part}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    verdict = compare(spark, con, str(tmp_path), name, QUERIES[name], CHECKS[name])
    assert verdict.startswith("ok ") and verdict != "ok but empty", verdict


def test_entry(spark):
    assert entries.entry(spark).count() > 0
