"""Constructed hourly load of reference consumers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.config import LoadProfile
from wattlake.functions import timecols as tc
from wattlake.functions.exprs import sum_if
from wattlake.operators.spine import calendar_spine


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def raw_weight(p: LoadProfile) -> Column:
    """Un-normalised weight of a calendar hour: day shape x season x maintenance.

    Day type priority: shutdown, then weekend or holiday, then weekday. The
    maintenance factor never applies inside the shutdown.
    """
    day = F.col("date_local")
    shutdown = tc.month_day_in_window(day, p.shutdown_start, p.shutdown_end)
    free = F.col("is_holiday_at") | (F.col("dow_local") >= 5)
    slot = F.col("hour_local") + 1
    shape = (
        F.when(shutdown, F.element_at(_array(p.shutdown), slot))
        .when(free, F.element_at(_array(p.weekend), slot))
        .otherwise(F.element_at(_array(p.weekday), slot))
    )
    seasonal = F.element_at(_array(p.seasonal), F.col("month_local"))
    monday = tc.first_monday_of_august(F.year(day))
    maintenance = day.between(monday, F.date_add(monday, 6)) & ~shutdown
    special = F.when(maintenance, F.lit(p.maintenance_factor)).otherwise(F.lit(1.0))
    return shape * seasonal * special


def weighted_hours(calendar: DataFrame, profiles: Sequence[LoadProfile]) -> DataFrame:
    """Calendar hours fanned out over the profiles, with ``annual_mwh`` and weight ``w``."""
    options = F.array(*[
        F.struct(F.lit(p.name).alias("profile"), F.lit(p.annual_mwh).alias("annual_mwh"),
                 raw_weight(p).alias("w"))
        for p in profiles
    ])
    return calendar.select("*", F.inline(options))


def hourly_load(calendar: DataFrame, profiles: Sequence[LoadProfile]) -> DataFrame:
    """``profile, ts_utc, load_mwh`` plus the calendar columns.

    Each year is scaled to the annual volume with the weight sum of the full
    local year, so a partial year keeps the monthly volumes of a full one.
    """
    years = calendar.agg(
        F.make_date(F.min("year_local"), F.lit(1), F.lit(1)).alias("first_day"),
        F.make_date(F.max("year_local"), F.lit(12), F.lit(31)).alias("last_day"),
    )
    totals = weighted_hours(calendar_spine(years), profiles).groupBy("profile", "year_local").agg(
        F.sum("w").alias("w_year")
    )
    hours = weighted_hours(calendar, profiles)
    # One row per profile and year: bounded by configuration times calendar.
    scaled = hours.join(F.broadcast(totals), ["profile", "year_local"])
    return scaled.withColumn("load_mwh", F.col("annual_mwh") * F.col("w") / F.col("w_year")).drop(
        "annual_mwh", "w", "w_year"
    )


def monthly_volumes(load: DataFrame) -> DataFrame:
    return load.groupBy("profile", "year_local", "month_local").agg(F.sum("load_mwh").alias("volume_mwh"))


def complete_years(calendar: DataFrame, year: str = "year_local") -> DataFrame:
    """Local years whose hours are all on the calendar."""
    n = calendar.groupBy(year).agg(F.count("*").alias("n"))
    return n.where(F.col("n") == tc.hours_in_local_year(F.col(year))).select(year)


def peak_share(load: DataFrame) -> DataFrame:
    """Share of volume in peak hours per profile, complete years only.

    Yearly sums come first; completeness is a filter on the yearly rows.
    """
    yearly = load.groupBy("profile", "year_local").agg(
        F.count("*").alias("n"),
        sum_if(F.col("is_peak_hour"), F.col("load_mwh")).alias("peak_mwh"),
        F.sum("load_mwh").alias("total_mwh"),
    )
    complete = yearly.where(F.col("n") == tc.hours_in_local_year(F.col("year_local")))
    return complete.groupBy("profile").agg((F.sum("peak_mwh") / F.sum("total_mwh")).alias("peak_share"))
