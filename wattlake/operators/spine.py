"""Generated time spines: the left side every fact joins onto.

A spine is bounded by the calendar (about 8,766 rows a year), whatever the
volume of the facts, so building it from one row of bounds is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.functions import timecols as tc


def calendar_bounds(df: DataFrame, day: Column, extra_months: int = 0) -> DataFrame:
    """One row ``(first_day, last_day)``; the end is a month end ``extra_months`` ahead."""
    bounds = df.agg(F.min(day.cast("date")).alias("first_day"), F.max(day.cast("date")).alias("m"))
    return bounds.select("first_day", F.last_day(F.add_months("m", extra_months)).alias("last_day"))


def day_spine(bounds: DataFrame) -> DataFrame:
    """One row per day between the bounds, both included."""
    days = F.sequence("first_day", "last_day", F.expr("interval 1 day"))
    return bounds.select(F.explode(days).alias("date_local"))


def month_spine(bounds: DataFrame, name: str = "month_start") -> DataFrame:
    """One first-of-month date per month touched by ``(first_day, last_day)``."""
    months = F.sequence(
        F.trunc("first_day", "MM"), F.trunc("last_day", "MM"), F.expr("interval 1 month")
    )
    return bounds.select(F.explode(months).alias(name))


def calendar_spine(bounds: DataFrame) -> DataFrame:
    """Hourly calendar of the local days in ``bounds``.

    Day attributes (holiday, weekend) are computed once per day and fanned out
    over the day's 23-25 hours, so daylight-saving days are right by
    construction.
    """
    start = tc.day_start_utc(F.col("date_local"))
    end = tc.day_start_utc(F.date_add("date_local", 1)) - F.expr("interval 1 hour")
    years = bounds.select(
        F.explode(F.sequence(F.year("first_day"), F.year("last_day"))).alias("year")
    )
    # Thirteen rows per calendar year: bounded whatever the data volume.
    holidays = F.broadcast(holiday_dimension(years).select("date_local", F.lit(True).alias("holiday")))
    days = day_spine(bounds).join(holidays, "date_local", "left").select(
        "date_local",
        tc.dow_monday0(F.col("date_local")).alias("dow_local"),
        F.col("holiday").isNotNull().alias("is_holiday_at"),
        F.year("date_local").alias("year_local"),
        F.month("date_local").alias("month_local"),
        F.sequence(start, end, F.expr("interval 1 hour")).alias("hours"),
    )
    hours = days.select("*", F.explode("hours").alias("ts_utc"))
    hour = F.hour(tc.local_time(F.col("ts_utc")))
    return hours.select(
        "ts_utc",
        "date_local",
        hour.alias("hour_local"),
        "dow_local",
        (F.col("dow_local") >= 5).alias("is_weekend"),
        "is_holiday_at",
        tc.is_peak_hour(F.col("dow_local"), hour, F.col("is_holiday_at")).alias("is_peak_hour"),
        "year_local",
        "month_local",
    )


def easter_sundays(years: DataFrame, year: str = "year") -> DataFrame:
    """``year, easter`` by the Gregorian (Meeus/Jones/Butcher) arithmetic.

    Each step is its own projection: as one nested expression the formula
    would repeat its sub-terms hundreds of times in the plan.
    """
    steps = {
        "golden": "y % 19",
        "century": "y div 100",
        "moon_shift": "(century - (century + 8) div 25 + 1) div 3",
        "epact": "(golden * 19 + century - century div 4 - moon_shift + 15) % 30",
        "to_sunday": "((century % 4) * 2 + ((y % 100) div 4) * 2 + 32 - epact - (y % 100) % 4) % 7",
        "correction": "(golden + epact * 11 + to_sunday * 22) div 451",
        "serial": "epact + to_sunday - correction * 7 + 114",
    }
    rows = years.select(F.col(year).cast("int").alias("y"))
    for name, step in steps.items():
        rows = rows.withColumn(name, F.expr(step).cast("int"))
    return rows.select(
        F.col("y").alias("year"), F.expr("make_date(y, serial div 31, serial % 31 + 1)").alias("easter")
    )


def holiday_dimension(years: DataFrame, year: str = "year") -> DataFrame:
    """``(year, date_local)`` for the thirteen holidays of each year."""
    rows = easter_sundays(years, year)
    dates = tc.holiday_dates(F.col("year"), F.col("easter"))
    return rows.select("year", F.explode(dates).alias("date_local"))


def integer_spine(low: int, high: int, name: str, like: DataFrame) -> DataFrame:
    """Rows ``low..high`` for zero-filling a fixed axis such as hours 0..23."""
    return like.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(name))
