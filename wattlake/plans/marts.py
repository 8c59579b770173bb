"""Star schema: calendar dimension and the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.functions import timecols as tc
from wattlake.functions.exprs import avg_if, cooling_degrees, heating_degrees
from wattlake.operators.joins import with_bounds
from wattlake.operators.series import share_of_group

CALENDAR_ATTRIBUTES = (
    "date_local", "year_local", "month_local", "hour_local", "dow_local", "is_weekend",
    "is_holiday_at", "is_peak_hour", "season", "hdd_18", "cdd_22",
)


def dim_calendar(spine: DataFrame, weather: DataFrame) -> DataFrame:
    """Hourly calendar with season and degree days (NULL without a temperature)."""
    joined = spine.join(weather, "date_local", "left")
    return joined.select(
        "ts_utc", "date_local", "year_local", "month_local", "hour_local", "dow_local",
        "is_weekend", "is_holiday_at", "is_peak_hour",
        tc.season(F.col("month_local")).alias("season"),
        heating_degrees(F.col("tavg_c")).alias("hdd_18"),
        cooling_degrees(F.col("tavg_c")).alias("cdd_22"),
    )


def fct_price_hourly(calendar: DataFrame, prices: DataFrame, load: DataFrame, zones: tuple[str, str] = ("AT", "DE_LU")) -> DataFrame:
    """Two zones and the load on the calendar; hours without data keep NULLs.

    Both zones are turned into columns by one conditional aggregation over
    the hourly prices, so they share a shuffle instead of two joins.
    """
    first, second = zones
    wide = prices.where(F.col("zone").isin(first, second)).groupBy("ts_utc").agg(
        F.max(F.when(F.col("zone") == first, F.col("price_eur_mwh"))).alias("price_at_eur_mwh"),
        F.max(F.when(F.col("zone") == second, F.col("price_eur_mwh"))).alias("price_delu_eur_mwh"),
    )
    hours = calendar.join(wide, "ts_utc", "left").join(
        load.select("ts_utc", F.col("load_mw").alias("load_at_mw")), "ts_utc", "left"
    )
    return hours.select(
        "ts_utc", "price_at_eur_mwh", "price_delu_eur_mwh",
        (F.col("price_at_eur_mwh") - F.col("price_delu_eur_mwh")).alias("spread_at_delu_eur_mwh"),
        "load_at_mw",
        (F.col("price_at_eur_mwh") < 0).alias("is_negative_price"),
        *CALENDAR_ATTRIBUTES,
    )


def fct_price_daily(hourly: DataFrame, weather: DataFrame) -> DataFrame:
    price = F.col("price_at_eur_mwh")
    daily = hourly.groupBy("date_local").agg(
        F.avg(price).alias("price_base_eur_mwh"),
        avg_if(F.col("is_peak_hour"), price).alias("price_peak_eur_mwh"),
        F.min(price).alias("price_min"),
        F.max(price).alias("price_max"),
        F.stddev_samp(price).alias("price_std"),
        F.count_if("is_negative_price").alias("n_negative_hours"),
        F.max("hdd_18").alias("hdd_18"),
        F.max("cdd_22").alias("cdd_22"),
    )
    return daily.join(weather, "date_local", "left").select(
        "date_local", "price_base_eur_mwh", "price_peak_eur_mwh", "price_min", "price_max",
        "price_std", "n_negative_hours", "tavg_c", "hdd_18", "cdd_22",
    )


def priced_window(hourly: DataFrame) -> DataFrame:
    """One row: first and last month with a price."""
    month = tc.month_of(F.col("year_local"), F.col("month_local"))
    return hourly.where(F.col("price_at_eur_mwh").isNotNull()).agg(
        F.min(month).alias("first_month"), F.max(month).alias("last_month")
    )


def fct_price_monthly(hourly: DataFrame, index: DataFrame) -> DataFrame:
    """Monthly prices inside the priced window, with the index of the month."""
    price = F.col("price_at_eur_mwh")
    monthly = hourly.groupBy("year_local", "month_local").agg(
        F.avg(price).alias("price_base_eur_mwh"),
        avg_if(F.col("is_peak_hour"), price).alias("price_peak_eur_mwh"),
        avg_if(~F.col("is_peak_hour"), price).alias("price_offpeak_eur_mwh"),
        F.count_if("is_negative_price").alias("n_negative_hours"),
        F.count(price).alias("n_priced"),
    )
    # The window follows from the monthly rows: no second pass over the hours.
    month = tc.month_of(F.col("year_local"), F.col("month_local"))
    window = monthly.where("n_priced > 0").agg(
        F.min(month).alias("first_month"), F.max(month).alias("last_month")
    )
    inside = with_bounds(monthly, window).where(month.between(F.col("first_month"), F.col("last_month")))
    by_month = index.select(
        F.year("month_local").alias("year_local"), F.month("month_local").alias("month_local"),
        "oespi_base", "oespi_peak",
    )
    return inside.join(by_month, ["year_local", "month_local"], "left").select(
        "year_local", "month_local", "price_base_eur_mwh", "price_peak_eur_mwh",
        "price_offpeak_eur_mwh", "n_negative_hours", "oespi_base", "oespi_peak",
    )


def fct_generation_monthly(generation: DataFrame, calendar: DataFrame) -> DataFrame:
    """Energy per plant type and month (sum of hourly MW / 1000 = GWh) and its share."""
    hours = generation.join(calendar.select("ts_utc", "year_local", "month_local"), "ts_utc")
    monthly = hours.groupBy("year_local", "month_local", "psr_type").agg(
        F.max("psr_name").alias("psr_name"), (F.sum("gen_mw") / F.lit(1000.0)).alias("gen_gwh")
    )
    share = share_of_group(F.col("gen_gwh"), ["year_local", "month_local"])
    return monthly.select(
        "year_local", "month_local", "psr_type", "psr_name", "gen_gwh", share.alias("share_of_total")
    )


def fct_consumer_load_hourly(load: DataFrame) -> DataFrame:
    return load.select(F.col("ts_utc").cast("timestamp"), F.col("load_mwh").cast("double"))


def fct_procurement_cost_monthly(costs: DataFrame) -> DataFrame:
    return costs.select(
        F.col("year_local").cast("int"), F.col("month_local").cast("int"),
        F.col("strategy_id").cast("string"), F.col("volume_mwh").cast("double"),
        F.col("cost_eur").cast("double"), F.col("unit_cost_eur_mwh").cast("double"),
    )


def fct_data_quality_monthly(hourly: DataFrame, prices: DataFrame, weather: DataFrame, index: DataFrame, zone: str = "AT") -> DataFrame:
    """Coverage, daylight-saving days, resolution mix and index presence per month.

    One aggregation per day and one per month replace separate scans for the
    expected hours, the DST days and the priced hours.
    """
    subhours = prices.where(F.col("zone") == zone).select("ts_utc", "n_subhours")
    per_day = hourly.join(subhours, "ts_utc", "left").groupBy("year_local", "month_local", "date_local").agg(
        F.count("*").alias("hours"),
        F.count("price_at_eur_mwh").alias("priced_at"),
        F.count("price_delu_eur_mwh").alias("priced_delu"),
        F.count("load_at_mw").alias("loads"),
        F.count_if("is_negative_price").alias("negative"),
        F.count_if(F.col("n_subhours") == 4).alias("quarters"),
    )
    monthly = per_day.groupBy("year_local", "month_local").agg(
        F.sum("hours").alias("expected_hours"),
        F.sum("priced_at").alias("priced_hours_at"),
        F.sum("priced_delu").alias("priced_hours_delu"),
        F.sum("loads").alias("load_hours"),
        F.count("*").alias("days_in_month"),
        F.count_if(F.col("hours") != 24).alias("n_dst_days"),
        F.sum("quarters").alias("n_hours_from_pt15m"),
        F.sum("negative").alias("n_negative_hours"),
    )
    month = tc.month_of(F.col("year_local"), F.col("month_local"))
    window = monthly.where("priced_hours_at > 0").agg(
        F.min(month).alias("first_month"), F.max(month).alias("last_month")
    )
    days = weather.groupBy(F.year("date_local").alias("year_local"), F.month("date_local").alias("month_local")).agg(
        F.count("tavg_c").alias("weather_days")
    )
    indexed = index.where(F.col("oespi_base").isNotNull()).select(
        F.year("month_local").alias("year_local"), F.month("month_local").alias("month_local"),
        F.lit(True).alias("has_oespi"),
    )
    keys = ["year_local", "month_local"]
    rows = (
        with_bounds(monthly, window)
        .where(month.between(F.col("first_month"), F.col("last_month")))
        .join(days, keys, "left")
        .join(indexed, keys, "left")
    )
    resolution = (
        F.when(F.col("n_hours_from_pt15m") == 0, "PT60M")
        .when(F.col("n_hours_from_pt15m") == F.col("priced_hours_at"), "PT15M")
        .otherwise("mixed")
    )
    return rows.select(
        *keys, "expected_hours", "priced_hours_at", "priced_hours_delu", "load_hours",
        F.coalesce("weather_days", F.lit(0)).alias("weather_days"),
        "days_in_month",
        F.round(F.lit(100.0) * F.col("priced_hours_at") / F.col("expected_hours"), 3).alias("coverage_at_pct"),
        "n_dst_days", "n_hours_from_pt15m", resolution.alias("resolution"), "n_negative_hours",
        F.coalesce("has_oespi", F.lit(False)).alias("has_oespi"),
    )


def spread_monthly(hourly: DataFrame) -> DataFrame:
    spread = F.col("spread_at_delu_eur_mwh")
    return hourly.where(spread.isNotNull()).groupBy("year_local", "month_local").agg(
        F.avg(spread).alias("spread_mean_eur_mwh"),
        (F.lit(100.0) * F.avg((spread > 0).cast("double"))).alias("share_at_above_de_pct"),
    )
