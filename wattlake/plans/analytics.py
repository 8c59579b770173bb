"""Descriptive market analytics on the hourly and daily facts.

Groups here are years or months of one hourly series (at most 8,784 rows), so
Spark's exact ``percentile`` and ``median`` are bounded; unbounded groups go
through ``operators.quantiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattlake.config import (
    CALM_MIN_SHARE,
    COMPLETE_YEAR_MIN_HOURS,
    CRISIS_MIN_SHARE,
    REGIME_LABELS,
    ROLLING_DAYS,
    SOLAR_HOURS,
    SOLAR_MONTHS,
    SPIKE_EUR_MWH,
)
from wattlake.functions.exprs import avg_if, ratio, share_if
from wattlake.operators.blocks import day_block, differences, running_total
from wattlake.operators.quantiles import group_mode
from wattlake.operators.spine import integer_spine


def priced_hours(hourly: DataFrame) -> DataFrame:
    return hourly.where(F.col("price_at_eur_mwh").isNotNull())


def complete_years(hourly: DataFrame, min_hours: int | Column = COMPLETE_YEAR_MIN_HOURS) -> DataFrame:
    """Years with enough priced hours to be read as annual."""
    n = priced_hours(hourly).groupBy("year_local").agg(F.count("*").alias("hours"))
    return n.where(F.col("hours") >= min_hours)


def annual_market_summary(hourly: DataFrame) -> DataFrame:
    """All per-year price statistics from one aggregation."""
    p, peak = F.col("price_at_eur_mwh"), F.col("is_peak_hour")
    negative = p < 0
    solar = F.col("month_local").between(*SOLAR_MONTHS) & F.col("hour_local").between(*SOLAR_HOURS)
    agg = priced_hours(hourly).groupBy(F.col("year_local").alias("year")).agg(
        F.count("*").alias("hours"), F.avg(p).alias("mean"), F.median(p).alias("median"),
        F.stddev_samp(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"),
        avg_if(peak, p).alias("peak"), avg_if(~peak, p).alias("offpeak"),
        F.count_if(negative).alias("neg_hours"),
        F.coalesce(-avg_if(negative, p), F.lit(0.0)).alias("neg_mean_depth"),
        F.count_if(negative & solar).alias("neg_solar"),
        F.count_if(p > SPIKE_EUR_MWH).alias("hours_above_500"),
    )
    pct = F.lit(100.0)
    return agg.select(
        "year", "hours", "mean", "median", "std", "min", "max", F.col("mean").alias("base"),
        "peak", "offpeak", (F.col("peak") - F.col("offpeak")).alias("peak_minus_offpeak"),
        "neg_hours", (pct * F.col("neg_hours") / F.col("hours")).alias("neg_share_pct"),
        "neg_mean_depth",
        F.coalesce(ratio(pct * F.col("neg_solar"), F.col("neg_hours")), F.lit(0.0)).alias("neg_share_solar_pct"),
        "hours_above_500",
    )


def spread_summary(hourly: DataFrame) -> DataFrame:
    s, peak = F.col("spread_at_delu_eur_mwh"), F.col("is_peak_hour")
    return hourly.where(s.isNotNull()).groupBy(F.col("year_local").alias("year")).agg(
        F.count("*").alias("hours"), F.avg(s).alias("mean"), F.median(s).alias("median"),
        F.stddev_samp(s).alias("std"), (F.lit(100.0) * share_if(s > 0)).alias("share_at_above_de_pct"),
        avg_if(peak, s).alias("mean_peak"), avg_if(~peak, s).alias("mean_offpeak"),
    )


def months_with_positive_spread(monthly: DataFrame) -> DataFrame:
    """Share of months whose mean spread is above zero."""
    return monthly.agg(
        F.count("*").alias("months"), share_if(F.col("spread_mean_eur_mwh") > 0).alias("share_up")
    )


def hour_month_grid(hourly: DataFrame) -> DataFrame:
    """Mean price by hour of day (rows 0-23) and month (columns m1-m12), per year."""
    p = F.col("price_at_eur_mwh")
    grid = priced_hours(hourly).groupBy("year_local", "hour_local").agg(
        *[avg_if(F.col("month_local") == m, p).alias(f"m{m}") for m in range(1, 13)]
    )
    years = grid.select("year_local").distinct()
    hours = F.sequence(F.lit(0), F.lit(23))
    axis = years.select("year_local", F.explode(hours).alias("hour_local"))
    return axis.join(grid, ["year_local", "hour_local"], "left")


def negative_hours_by_hour(hourly: DataFrame) -> DataFrame:
    counts = hourly.where("price_at_eur_mwh < 0").groupBy("hour_local").agg(F.count("*").alias("n"))
    axis = integer_spine(0, 23, "hour_local", hourly)
    return axis.join(counts, "hour_local", "left").select("hour_local", F.coalesce("n", F.lit(0)).alias("n"))


def daily_differences(daily: DataFrame, keys: Sequence[str] = (), value: str = "price_base_eur_mwh") -> DataFrame:
    """``d_t`` and 30-day realised volatility per series; the first day has no difference."""
    rows = daily.where(F.col(value).isNotNull())
    rows = differences(rows, keys, "date_local", value, day_block("date_local"), ROLLING_DAYS)
    return rows.where(F.col("d_t").isNotNull())


def regime_stats(labelled: DataFrame) -> DataFrame:
    """Days, occupancy, mean absolute change and mean price per regime."""
    stats = labelled.groupBy("regime").agg(
        F.count("*").alias("days"),
        F.avg(F.abs("d_t")).alias("mean_abs_d_t"),
        F.avg("price_base_eur_mwh").alias("mean_price"),
    )
    total = stats.agg(F.sum("days")).scalar()
    return stats.select(
        "regime", "days", (F.lit(100.0) * F.col("days") / total).alias("occupancy_pct"), "mean_abs_d_t", "mean_price"
    )


def regime_gate(labelled: DataFrame, first: str, last: str, calm_year: int) -> DataFrame:
    """Shares behind the plausibility gate of the regime labels, and the verdict."""
    day, regime = F.col("date_local"), F.col("regime")
    window = day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    top2 = regime.isin(*REGIME_LABELS[1:]).cast("double")
    calm = (regime == REGIME_LABELS[0]).cast("double")
    shares = labelled.agg(
        F.coalesce(avg_if(window, top2), F.lit(0.0)).alias("crisis_top2_share"),
        F.coalesce(avg_if(F.year(day) == calm_year, calm), F.lit(0.0)).alias("calm_year_share"),
    )
    return shares.withColumn(
        "passed",
        (F.col("crisis_top2_share") >= CRISIS_MIN_SHARE) & (F.col("calm_year_share") >= CALM_MIN_SHARE),
    )


def monthly_modal_regime(labelled: DataFrame, monthly: DataFrame) -> DataFrame:
    """Monthly base price beside the month's most frequent regime."""
    days = labelled.select(
        F.year("date_local").alias("year_local"), F.month("date_local").alias("month_local"), "regime"
    )
    modes = group_mode(days, ["year_local", "month_local"], "regime", "regime")
    return monthly.select("year_local", "month_local", "price_base_eur_mwh").join(
        modes, ["year_local", "month_local"], "left"
    )


def daily_load(hourly: DataFrame, daily: DataFrame) -> DataFrame:
    """Regression input: mean load, day type, month and heating degrees per day."""
    free = F.col("is_weekend") | F.col("is_holiday_at")
    load = hourly.where(F.col("load_at_mw").isNotNull()).groupBy("date_local").agg(
        F.avg("load_at_mw").alias("load_mean_mw"),
        F.bool_or(free).alias("is_weekend_or_holiday"),
        F.min("month_local").alias("month_local"),
    )
    return load.join(
        daily.where(F.col("hdd_18").isNotNull()).select("date_local", "hdd_18"), "date_local"
    )


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """P5/P25/P50/P75/P95 per bounded group."""
    names = ("p5", "p25", "p50", "p75", "p95")
    q = F.percentile(F.col(value), F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    return df.groupBy(*keys).agg(q.alias("q")).select(
        *keys, *[F.col("q")[i].alias(n) for i, n in enumerate(names)]
    )


def strategy_year_matrix(costs: DataFrame) -> DataFrame:
    """Cost and unit cost by strategy and year with the strategy totals (``year`` NULL)."""
    return costs.groupingSets(
        [[F.col("strategy_id"), F.col("year_local")], [F.col("strategy_id")]], "strategy_id", "year_local"
    ).agg(
        F.sum("cost_eur").alias("cost_eur"),
        ratio(F.sum("cost_eur"), F.sum("volume_mwh")).alias("unit_cost_eur_mwh"),
        F.grouping("year_local").cast("int").alias("is_total"),
    )


def strategy_by_year(annual: DataFrame, years: Sequence[int]) -> DataFrame:
    """Wide cost matrix: one row per strategy, one column per year."""
    return annual.groupBy("strategy_id").pivot("year", list(years)).agg(F.sum("cost_eur"))


def cumulative_cost(costs: DataFrame) -> DataFrame:
    """Running cost per strategy, month by month; a year is a block."""
    monthly = costs.groupBy("strategy_id", "year_local", "month_local").agg(F.sum("cost_eur").alias("cost_eur"))
    return running_total(monthly, ["strategy_id"], ["month_local"], "cost_eur", "cumulative_eur", F.col("year_local"))


def annual_quality(dq: DataFrame) -> DataFrame:
    """Yearly roll-up of the monthly data-quality mart."""
    expected = F.sum("expected_hours")

    def pct(part: str, whole=None):  # noqa: ANN001, ANN202
        return F.round(F.lit(100.0) * F.sum(part) / (expected if whole is None else whole), 2)

    return dq.groupBy(F.col("year_local").alias("year")).agg(
        expected.alias("expected_hours"),
        F.sum("priced_hours_at").alias("priced_hours_at"),
        pct("priced_hours_at").alias("coverage_at_pct"),
        pct("priced_hours_delu").alias("coverage_delu_pct"),
        pct("load_hours").alias("coverage_load_pct"),
        pct("weather_days", F.sum("days_in_month")).alias("coverage_weather_pct"),
        F.sum("n_dst_days").alias("dst_days"),
        F.sum("n_hours_from_pt15m").alias("hours_from_pt15m"),
        F.sum("n_negative_hours").alias("negative_hours"),
        F.count_if("has_oespi").alias("oespi_months"),
        F.count("*").alias("months"),
    )


def mart_coverage(marts: dict[str, DataFrame]) -> DataFrame:
    """First, last and number of months per monthly mart."""
    out = None
    for name, frame in marts.items():
        month = F.make_date("year_local", "month_local", F.lit(1))
        row = frame.agg(
            F.lit(name).alias("mart_name"), F.min(month).alias("min_month"),
            F.max(month).alias("max_month"), F.count_distinct(month).alias("n_months"),
        )
        out = row if out is None else out.unionByName(row)
    return out
