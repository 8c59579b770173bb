"""Calendar arithmetic as column expressions (UTC session assumed).

Stored timestamps are UTC instants; every local attribute goes through
``local_time`` once. Nothing here needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattlake.config import LOCAL_ZONE, PEAK_END_HOUR, PEAK_START_HOUR, WINTER_MONTHS


def local_time(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Wall-clock time in ``zone`` of a UTC instant."""
    return F.from_utc_timestamp(ts, zone)


def utc_of_local(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC instant of a wall-clock time in ``zone``."""
    return F.to_utc_timestamp(ts, zone)


def dow_monday0(day: Column) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(day)


def dow_sunday0(day: Column) -> Column:
    """Day of week with Sunday = 0."""
    return F.dayofweek(day) - F.lit(1)


def day_start_utc(day: Column, zone: str = LOCAL_ZONE) -> Column:
    return utc_of_local(day.cast("timestamp"), zone)


def hours_in_local_day(day: Column, zone: str = LOCAL_ZONE) -> Column:
    """23, 24 or 25: the length of local ``day`` measured in UTC."""
    start = F.unix_seconds(day_start_utc(day, zone))
    end = F.unix_seconds(day_start_utc(F.date_add(day, 1), zone))
    return ((end - start) / F.lit(3600)).cast("int")


def hours_in_local_year(year: Column, zone: str = LOCAL_ZONE) -> Column:
    first = F.make_date(year, F.lit(1), F.lit(1))
    following = F.make_date(year + 1, F.lit(1), F.lit(1))
    span = F.unix_seconds(day_start_utc(following, zone)) - F.unix_seconds(
        day_start_utc(first, zone)
    )
    return (span / F.lit(3600)).cast("int")


def is_leap_year(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def last_sunday(year: Column, month: int) -> Column:
    """Date of the last Sunday in a 31-day ``month``."""
    end = F.make_date(year, F.lit(month), F.lit(31))
    return F.date_sub(end, dow_sunday0(end))


def first_monday_of_august(year: Column) -> Column:
    return F.next_day(F.date_sub(F.make_date(year, F.lit(8), F.lit(1)), 1), "Mon")


def month_of(year: Column, month: Column) -> Column:
    """First-of-month date from a (year, month) pair."""
    return F.make_date(year, month, F.lit(1))


def month_label(year: Column, month: Column) -> Column:
    """``YYYY-MM``."""
    return F.format_string("%04d-%02d", year, month)


#: Austrian public holidays as (month, day) and as days after Easter.
FIXED_HOLIDAYS = ((1, 1), (1, 6), (5, 1), (8, 15), (10, 26), (11, 1), (12, 8), (12, 25), (12, 26))
EASTER_OFFSETS = (1, 39, 50, 60)


def holiday_dates(year: Column, easter: Column) -> Column:
    """Array of the public holidays of ``year`` (Austria, Styria included)."""
    fixed = [F.make_date(year, F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS]
    return F.array(*fixed, *[F.date_add(easter, offset) for offset in EASTER_OFFSETS])


def is_peak_hour(dow0: Column, hour: Column, holiday: Column) -> Column:
    """Mon-Fri 08-20 local, holidays excluded (``dow0``: Monday = 0)."""
    return (dow0 < 5) & (hour >= PEAK_START_HOUR) & (hour < PEAK_END_HOUR) & ~holiday


def season(month: Column) -> Column:
    return F.when(month.isin(*WINTER_MONTHS), F.lit("winter")).otherwise(F.lit("summer"))


def month_day_in_window(day: Column, start: str, end: str) -> Column:
    """``MM-DD`` window test that may wrap around New Year."""
    key = F.date_format(day, "MM-dd")
    if start <= end:
        return (key >= start) & (key <= end)
    return (key >= start) | (key <= end)


def resolution_minutes(resolution: Column) -> Column:
    """Minutes per point of a ``PTnnM`` code; an unknown code is an error."""
    minutes = F.regexp_extract(resolution, r"^PT(15|30|60)M$", 1)
    return F.when(minutes != "", minutes.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("unsupported resolution: "), F.coalesce(resolution, F.lit("null"))))
        .cast("int")
    )
