"""Named measures of the dashboard layer, each a small aggregation.

A measure takes an already filtered frame: slicers are ``where`` clauses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.functions.exprs import ratio
from wattlake.operators.series import above_group_min, running_total

NON_NUMERIC_UNITS = ("strategy_id", "month", "months")


def cost_totals(costs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total cost, total volume and unit cost."""
    return costs.groupBy(*keys).agg(
        F.sum("cost_eur").alias("total_cost_eur"), F.sum("volume_mwh").alias("total_volume_mwh"),
        ratio(F.sum("cost_eur"), F.sum("volume_mwh")).alias("unit_cost_eur_per_mwh"),
    )


def price_averages(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return monthly.groupBy(*keys).agg(
        F.avg("price_base_eur_mwh").alias("avg_base_price"),
        F.avg("price_peak_eur_mwh").alias("avg_peak_price"),
        F.avg("price_offpeak_eur_mwh").alias("avg_offpeak_price"),
        F.sum("n_negative_hours").alias("negative_price_hours"),
    )


def wrong_strategy_cost(costs: DataFrame, year: str = "year_local") -> DataFrame:
    """Sum over the visible years of dearest minus cheapest strategy."""
    by = costs.groupBy(year, "strategy_id").agg(F.sum("cost_eur").alias("c"))
    gaps = by.groupBy(year).agg((F.max("c") - F.min("c")).alias("gap"))
    return gaps.agg(F.sum("gap").alias("wrong_strategy_cost_eur"))


def cheapest_strategy(costs: DataFrame, labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Label of the cheapest strategy; ties go to the lower sort order.

    ``labels`` is the strategy dimension (a handful of rows).
    """
    total = costs.groupBy(*keys, "strategy_id").agg(F.sum("cost_eur").alias("c")).where("c is not null")
    named = total.join(F.broadcast(labels), "strategy_id")
    return named.groupBy(*keys).agg(
        F.min_by("strategy_label", F.struct("c", "sort_order")).alias("cheapest_strategy")
    )


def cost_vs_cheapest(costs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    total = costs.groupBy(*keys, "strategy_id").agg(F.sum("cost_eur").alias("total_cost_eur"))
    if keys:
        return total.withColumn("cost_vs_cheapest_eur", above_group_min(F.col("total_cost_eur"), keys))
    low = total.agg(F.min("total_cost_eur")).scalar()
    return total.withColumn("cost_vs_cheapest_eur", F.col("total_cost_eur") - low)


def cumulative_cost(costs: DataFrame, first_visible: str, last_visible: str) -> DataFrame:
    """Running total since the beginning, shown for the visible months only."""
    monthly = costs.groupBy("strategy_id", "year_local", "month_local").agg(F.sum("cost_eur").alias("cost_eur"))
    run = running_total(monthly, ["strategy_id"], ["year_local", "month_local"], "cost_eur", "cumulative_cost_eur")
    month = F.make_date("year_local", "month_local", F.lit(1))
    return run.where(month.between(F.lit(first_visible).cast("date"), F.lit(last_visible).cast("date")))


def forward_metrics(summary: DataFrame, variant: str = "unconditional", keys: Sequence[str] = ()) -> DataFrame:
    """Averages of the forward statistics for one variant, and the tail spread."""
    rows = summary.where(F.col("variant") == variant)
    out = rows.groupBy(*keys).agg(*[
        F.avg(c).alias(f"forward_{c}_eur") for c in ("mean", "p5", "p50", "p95", "cvar95")
    ])
    return out.withColumn("tail_spread_eur", F.col("forward_p95_eur") - F.col("forward_p50_eur"))


def path_measures(paths: DataFrame, variant: str = "unconditional", keys: Sequence[str] = ()) -> DataFrame:
    return paths.where(F.col("variant") == variant).groupBy(*keys).agg(
        F.count("*").alias("paths"), (F.sum("cost_eur") / F.lit(1e6)).alias("path_cost_eur_million")
    )


def quality_measures(dq: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return dq.groupBy(*keys).agg(
        F.sum("expected_hours").alias("expected_hours"), F.sum("priced_hours_at").alias("priced_hours_at"),
        (ratio(F.sum("priced_hours_at"), F.sum("expected_hours")) * 100).alias("price_coverage_pct"),
        F.coalesce(F.count_if(F.col("coverage_at_pct") < 100), F.lit(0)).alias("months_below_full_coverage"),
        F.sum("n_dst_days").alias("dst_days"),
        F.sum("n_hours_from_pt15m").alias("hours_from_15min_quarters"),
        F.coalesce(F.count_if(~F.col("has_oespi")), F.lit(0)).alias("months_missing_index"),
    )


def number_lookup(numbers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Published values by key: text always, a number only for numeric units."""
    numeric = F.when(~F.col("unit").isin(*NON_NUMERIC_UNITS), F.expr("try_cast(value as double)"))
    return numbers.where(F.col("key").isin(*keys)).select("key", "value", "unit", numeric.alias("number"))


def date_table(first: DataFrame) -> DataFrame:
    """Daily table from the first date to the end of the month a year after the last.

    ``first`` is one row ``(first_day, last_day)``.
    """
    days = F.sequence("first_day", F.last_day(F.add_months("last_day", 12)), F.expr("interval 1 day"))
    return first.select(F.explode(days).alias("date")).select(
        "date", F.year("date").alias("year"), F.month("date").alias("month"),
        F.trunc("date", "MM").alias("month_start"),
    )


def monthly_market_payload(monthly: DataFrame, spread: DataFrame) -> DataFrame:
    """Month rows with base, peak and spread."""
    joined = monthly.join(spread, ["year_local", "month_local"], "left")
    return joined.select(
        F.format_string("%04d-%02d", "year_local", "month_local").alias("month"),
        F.col("price_base_eur_mwh").alias("base"), F.col("price_peak_eur_mwh").alias("peak"),
        F.col("spread_mean_eur_mwh").alias("spread"),
    )


def yearly_negative_hours(monthly: DataFrame) -> DataFrame:
    """Negative hours per year; years with fewer than twelve months are partial."""
    return monthly.groupBy("year_local").agg(
        F.sum("n_negative_hours").alias("neg_hours"), (F.count("n_negative_hours") < 12).alias("is_partial")
    )
