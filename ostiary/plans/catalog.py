"""Registry of runnable queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def r4(value: Column | str, name: str | None = None, digits: int = 4) -> Column:
    """Decimals at the query edge, where two engines are compared. The tiny shift moves exact halves, which the
    engines round differently, off the border; adding zero turns -0.0 into 0.0."""
    label = name or (value if isinstance(value, str) else None)
    value = F.col(value) if isinstance(value, str) else value
    rounded = F.round(value + 10.0 ** -(digits + 3), digits) + F.lit(0.0)
    return rounded.alias(label) if label else rounded


def sr4(expression: str, name: str, digits: int = 4) -> str:
    return f"round({expression} + 1e-{digits + 3}, {digits}) + 0.0 AS {name}"
