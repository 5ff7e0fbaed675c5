"""The named queries and the SQL that their rows are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: SQL over the views, by name, for statements that are made of others.
STATEMENTS: dict[str, str] = {}


def named(name: str, sql: str | None, build: Callable[..., DataFrame], *views: str) -> None:
    """Registers ``build`` of the views, and SQL over the same views under names with a v_ before."""
    QUERIES[name] = lambda spark, sf_dir: build(*[view(spark, sf_dir, v) for v in views])
    if sql:
        STATEMENTS[name] = sql.strip()
        ORACLES[name] = oracle(sql)
