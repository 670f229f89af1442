"""Registry of the named queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tanadex.plans.inputs import Inputs, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, *names: str):
    """Register ``fn(inputs)`` under a name, with its checking SQL over named inputs."""
    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            CHECKS[name] = check_sql(sql, *names)
        return fn
    return register
