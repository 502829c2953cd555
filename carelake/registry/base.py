"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.registry.sql import q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def register(fn):
        add(name, fn, sql)
        return fn
    return register


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = q(sql)


def n_rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)
