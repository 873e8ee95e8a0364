"""Registry of runnable queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalars import format_money

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def num(value: Column | str, places: int = 6) -> Column:
    """Comparable output number: double rounded to fixed places, in binary as the comparison SQL rounds it."""
    column = F.col(value) if isinstance(value, str) else value
    scale = float(10**places)
    return F.round(column.cast("double") * scale) / scale


def money(value: Column | str) -> Column:
    """Comparable output amount: exact text with 8 places."""
    return format_money(value)
