"""Query registry.

A query is a function of ``Feeds``; its oracle is SQL over the same base
tables and may use the shared table expressions of ``oracle.EXPRESSIONS``.
``doubles`` lists the floating columns with the digits both sides are rounded
to, because sums of doubles depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlake.queries.feeds import Feeds, feeds_for
from wattlake.queries.oracle import with_expressions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DEFAULT_DIGITS = 6


def _digits(doubles: str) -> dict[str, int]:
    out = {}
    for item in doubles.split():
        name, _, digits = item.partition(":")
        out[name] = int(digits) if digits else DEFAULT_DIGITS
    return out


def _finish(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if f.name in digits:
            col = F.round(col, digits[f.name]) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            col = col.cast("timestamp_ntz")
        cols.append(col.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable:
    """Register ``fn(feeds)`` under ``name`` with its oracle."""
    digits = _digits(doubles)

    def register(fn: Callable[[Feeds], DataFrame]) -> Callable[[Feeds], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: _finish(fn(feeds_for(spark, sf_dir)), digits)
        if sql is not None:
            ORACLES[name] = with_expressions(sql, digits)
        return fn

    return register
