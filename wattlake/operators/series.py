"""Window operators on regular series.

Inputs are aggregated grains (hour, day or month per series), so a partition
holds at most the calendar length of one series. ``gap_minutes`` is the one
operator for raw ticks and splits each series by hour.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlake.config import ROLLING_DAYS
from wattlake.operators.blocks import global_rank
from wattlake.session import stored_table


def difference(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "d_t") -> DataFrame:
    """Arithmetic first difference (prices may be negative, so never logs)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.col(value) - F.lag(value).over(w))


def rolling_std(
    df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int = ROLLING_DAYS, name: str = "realized_vol"
) -> DataFrame:
    """Sample standard deviation of the last ``rows`` values, NULL until all are present."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), Window.currentRow)
    full = F.count(value).over(w) == rows
    return df.withColumn(name, F.when(full, F.stddev_samp(value).over(w)))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w))


def relative_change(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.try_divide(F.col(value), F.lag(value).over(w)) - F.lit(1.0))


def index_to_first(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Series scaled so that its first non-NULL value is 100."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    first = F.first(value, ignorenulls=True).over(w)
    return df.withColumn(name, F.lit(100.0) * F.col(value) / first)


def share_of_group(value: Column, keys: Sequence[str]) -> Column:
    return value / F.sum(value).over(Window.partitionBy(*keys))


def above_group_min(value: Column, keys: Sequence[str]) -> Column:
    return value - F.min(value).over(Window.partitionBy(*keys))


def rank_in_group(value: Column, keys: Sequence[str]) -> Column:
    return F.rank().over(Window.partitionBy(*keys).orderBy(value))


def duration_curve(df: DataFrame, keys: Sequence[str], value: str, parts: int = 64) -> DataFrame:
    """Values sorted high to low against the share of time, 0-100 %.

    Approximate quantiles cut each group into ranges, which are ranked by their own tasks and moved on by the
    rows of the ranges before, so a group of any size is ranked by many tasks. Equal values share a range.
    The quantiles depend on the order in which partial results arrive, and the ranges are read twice (to count and
    to rank), so they are written once: two computations need not agree.
    """
    bounds = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = stored_table(df.groupBy(*keys).agg(F.percentile_approx(value, bounds, F.lit(1000)).alias("_cuts")))
    matched = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], F.lit(True))
    rows = df.select(*keys, value).alias("l").join(cuts.alias("c"), matched).select("l.*", "_cuts")
    higher = F.size(F.filter("_cuts", lambda c: c > F.col(value)))
    ranked = global_rank(rows, keys, [F.col(value).desc()], higher, "rank", "_n")
    share = F.when(F.col("_n") > 1, F.lit(100.0) * (F.col("rank") - 1) / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    return ranked.select(*keys, F.col(value), share.alias("share_pct"), F.col("rank").cast("int").alias("rank"))


def runner_up(df: DataFrame, keys: Sequence[str], label: str, value: str) -> DataFrame:
    """Lowest and second-lowest label per group, and the margin between them."""
    w = Window.partitionBy(*keys).orderBy(value, label)
    ranked = df.select(
        *keys,
        F.row_number().over(w).alias("rn"),
        F.col(label).alias("best"),
        F.lead(label).over(w).alias("runner_up"),
        (F.lead(value).over(w) - F.col(value)).alias("margin"),
    )
    return ranked.where("rn = 1").drop("rn")


def gap_minutes(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Minutes since the previous timestamp of the same series, on raw ticks.

    A series of ticks is unbounded, so the window runs per (series, hour); the
    last tick of the previous non-empty hour is carried over from an
    aggregated table with one row per series and hour.
    """
    keys = list(keys)
    rows = df.withColumn("_hour", F.date_trunc("hour", ts))
    last = rows.groupBy(*keys, "_hour").agg(F.max(ts).alias("_last"))
    before = last.select(
        *keys, "_hour", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_hour")).alias("_before")
    )
    inside = F.lag(ts).over(Window.partitionBy(*keys, "_hour").orderBy(ts))
    previous = F.coalesce(inside, F.col("_before"))
    gap = (F.unix_micros(ts) - F.unix_micros(previous)) / F.lit(60_000_000.0)
    return rows.join(before, [*keys, "_hour"]).withColumn("gap_minutes", gap).drop("_hour", "_before")
