"""Deduplication without windows over raw rows.

``row_number() = 1`` needs every copy of a key on one task, sorted. An ordered
``min_by`` keeps one candidate per key on the map side instead, so a key that
holds a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_key(order_by: Sequence[tuple[Column, bool]]) -> Column:
    """Struct that sorts ascending as ``order_by`` asks; NULLs last.

    ``order_by`` holds ``(column, descending)`` pairs; a descending column
    must be numeric (use ``unix_micros`` for timestamps).
    """
    parts: list[Column] = []
    for i, (column, descending) in enumerate(order_by):
        parts.append(column.isNull().alias(f"null_{i}"))
        parts.append((-column if descending else column).alias(f"key_{i}"))
    return F.struct(*parts)


def first_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[tuple[Column, bool]]
) -> DataFrame:
    """The first row of each key in the given total order."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), order_key(order_by)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, "best.*").select(*df.columns)


def latest_wins(
    df: DataFrame,
    keys: Sequence[str],
    ingested_at: str,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Most recently ingested version of each key, ties broken by ``tie_break`` ascending."""
    stamp = F.unix_micros(F.to_timestamp(F.col(ingested_at)))
    order = [(stamp, True), *[(F.col(c), False) for c in tie_break]]
    return first_per_key(df, keys, order)


def duplicate_surplus(df: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Rows beyond the first per key, summed per ``group`` (two partial aggregations)."""
    per_key = df.groupBy(*group, *[k for k in keys if k not in group]).agg(F.count("*").alias("n"))
    return (
        per_key.where("n > 1")
        .groupBy(*group)
        .agg(F.sum(F.col("n") - 1).alias("n_duplicates"))
    )


#: Copies of a row that one array holds.
COPY_SLICE = 4096


def drop_refetched(df: DataFrame, response: str, data_cols: Sequence[str]) -> DataFrame:
    """Union of ordered responses without rows an earlier response already delivered.

    Copies inside one response and rows that differ in any value all stay.
    The first response of a row is found with one aggregation; the surviving
    copies are its count in that response, re-expanded, so a row delivered a
    million times never meets itself in a window.
    """
    per_response = df.groupBy(*data_cols, response).agg(F.count("*").alias("copies"))
    first = per_response.groupBy(*data_cols).agg(
        F.min(F.struct(F.col(response), F.col("copies"))).alias("first")
    )
    # Copies are written out slice by slice, so no row ever holds an array of all of them.
    sliced = first.select(
        *data_cols, F.col(f"first.{response}").alias(response), F.col("first.copies").alias("copies"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("first.copies") - 1, F.lit(COPY_SLICE).cast("bigint"))).alias("start"),
    )
    size = F.least(F.lit(COPY_SLICE).cast("bigint"), F.col("copies") - F.col("start")).cast("int")
    return sliced.select(*data_cols, response, F.explode(F.sequence(F.lit(1), size)).alias("copy_no")).drop("copy_no")
