"""Registry of driver queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
# Queries that work through tables which batches write: they run as they are built.
BATCH_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BATCH_ORACLE: dict[str, str] = {}

# ---- fixed values: query parameters ----
FIXED_NOW = "2024-07-16 00:00:00"
FIXED_NOW_ISO = "2024-07-16T00:00:00+00:00"
# ---- end of fixed values ----


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def register_batches(name: str, sql: str):
    """As ``register``, for a query that writes tables on its way."""
    def wrap(fn):
        BATCH_QUERIES[name], BATCH_ORACLE[name] = fn, sql
        return fn
    return wrap
