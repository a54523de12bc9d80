"""Queries by name, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .entities import Exchange, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of an Exchange under its own name, with sql (over entities and tables) as its oracle."""

    def register(f: Callable[[Exchange], DataFrame]) -> Callable[[Exchange], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Exchange(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return register
