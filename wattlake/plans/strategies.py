"""Retrospective pricing of procurement strategies.

All scenarios are rows of one small parameter table, so the sensitivity grid
is one plan and one pass over the hours, not a rerun per scenario.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.config import FLAT_PROFILE, StrategyConfig, hybrid_id
from wattlake.functions.exprs import avg_if, ratio, sum_if
from wattlake.operators.series import above_group_min, rank_in_group


def monthly_spot(load: DataFrame, price_hourly: DataFrame, keys: Sequence[str] = ("profile",)) -> DataFrame:
    """Priced volume and spot cost per month.

    Hours without a price leave both cost and volume, so every strategy prices
    the same volume. The price fact already carries the calendar, hence a
    single join; it is one row per hour and the load side may hold many
    consumers.
    """
    price = price_hourly.select("ts_utc", "year_local", "month_local", "price_at_eur_mwh")
    hours = load.select(*keys, "ts_utc", "load_mwh").join(price, "ts_utc")
    has_price = F.col("price_at_eur_mwh").isNotNull()
    return (
        hours.groupBy(*keys, "year_local", "month_local")
        .agg(
            sum_if(has_price, F.col("load_mwh")).alias("volume_mwh"),
            F.sum(F.col("load_mwh") * F.col("price_at_eur_mwh")).alias("spot_cost_eur"),
            F.count_if(~has_price).alias("dropped_hours"),
            F.count_if(has_price).alias("priced_hours"),
        )
        .where("priced_hours > 0")
    )


def observed_index(price_monthly: DataFrame) -> DataFrame:
    """Index months that are inside the priced window."""
    return price_monthly.where(F.col("oespi_base").isNotNull()).select(
        "year_local", "month_local", "oespi_base", "oespi_peak"
    )


def reference_stats(load: DataFrame, price_hourly: DataFrame, year: int, keys: Sequence[str] = ("profile",)) -> DataFrame:
    """Cost, volume and mean prices of the reference year per consumer."""
    price = price_hourly.where((F.col("year_local") == year) & F.col("price_at_eur_mwh").isNotNull()).select(
        "ts_utc", "is_peak_hour", "price_at_eur_mwh"
    )
    hours = load.select(*keys, "ts_utc", "load_mwh").join(price, "ts_utc")
    value = F.col("price_at_eur_mwh")
    return hours.groupBy(*keys).agg(
        F.sum(F.col("load_mwh") * value).alias("consumer_cost_eur"),
        F.sum("load_mwh").alias("consumer_volume_mwh"),
        F.avg(value).alias("mean_price_all_hours_eur_mwh"),
        avg_if(F.col("is_peak_hour"), value).alias("mean_price_peak_eur_mwh"),
    )


def anchors(reference: DataFrame, index: DataFrame, year: int) -> DataFrame:
    """Reference prices and index means that turn index points into EUR/MWh."""
    months = index.where(F.col("year_local") == year).agg(
        F.count("*").alias("n"), F.avg("oespi_base").alias("b"), F.avg("oespi_peak").alias("p")
    )
    complete = F.when(F.col("n") == 12, F.col("b")).otherwise(
        F.raise_error(F.concat(F.lit("index reference year has months: "), F.col("n").cast("string"))).cast("double")
    )
    index_ref = months.select(F.struct(complete.alias("b"), F.col("p").alias("p")).alias("r")).scalar()
    base = F.col("consumer_cost_eur") / F.col("consumer_volume_mwh")
    peak = F.col("mean_price_peak_eur_mwh") * (base / F.col("mean_price_all_hours_eur_mwh"))
    keys = [c for c in reference.columns if c not in (
        "consumer_cost_eur", "consumer_volume_mwh", "mean_price_all_hours_eur_mwh", "mean_price_peak_eur_mwh")]
    return reference.withColumn("r", index_ref).select(
        *keys, base.alias("p_ref_base"), peak.alias("p_ref_peak"),
        F.col("r.b").alias("oespi_base_ref"), F.col("r.p").alias("oespi_peak_ref"),
    )


def scenario_grid(anchor_rows: DataFrame, shares: DataFrame, cfg: StrategyConfig, base_only: bool = False) -> DataFrame:
    """Parameter table: the base case and each single-change scenario of every consumer.

    The flat load is itself a scenario; any other profile is a consumer with all of them.
    """
    rows = [("base", False, cfg.premium, cfg.lock_months)]
    if not base_only:
        rows += [(f"premium_{p:g}", False, p, cfg.lock_months) for p in cfg.premium_grid]
        rows += [
            ("flat_baseload", True, cfg.premium, cfg.lock_months),
            ("lock_full_prior_year", False, cfg.premium, cfg.lock_months_alternative),
        ]
    options = F.array(*[
        F.struct(F.lit(name).alias("scenario"), F.lit(flat).alias("for_flat"),
                 F.lit(float(premium)).alias("premium"),
                 F.array(*[F.lit(m) for m in months]).alias("lock_months"))
        for name, flat, premium, months in rows
    ])
    # Explode the fixed options beside each profile's anchors, keep its kind.
    joined = anchor_rows.join(shares.withColumnRenamed("peak_share", "w_peak"), "profile")
    return joined.select("*", F.inline(options)).where(
        (F.col("profile") == FLAT_PROFILE.name) == F.col("for_flat")
    ).drop("for_flat")


def blended_price(base: Column, peak: Column, peak_available: bool = True) -> Column:
    """EUR/MWh of index values under the parameter columns in scope."""
    base_leg = F.col("p_ref_base") * base / F.col("oespi_base_ref")
    if not peak_available:
        return base_leg
    peak_leg = F.col("p_ref_peak") * peak / F.col("oespi_peak_ref")
    return base_leg * (F.lit(1.0) - F.col("w_peak")) + peak_leg * F.col("w_peak")


def lock_prices(index: DataFrame, params: DataFrame, years: Sequence[int], peak_available: bool = True) -> DataFrame:
    """Fixed price per consumer, scenario and delivery year, from last year's lock months only.

    Exploding the lock months makes this an equi join on the month; an
    incomplete window is an error rather than a mean over fewer months.
    """
    months = params.select("*", F.explode("lock_months").alias("month_local"))
    param_cols = params.columns
    # The index has one row per month; parameters have rows per consumer.
    windows = months.join(F.broadcast(index.where((F.col("year_local") + 1).isin(*years))), "month_local")
    grouped = windows.groupBy(*param_cols, (F.col("year_local") + 1).alias("year_local")).agg(
        F.avg("oespi_base").alias("b"), F.avg("oespi_peak").alias("p"), F.count("oespi_base").alias("n")
    )
    price = blended_price(F.col("b"), F.col("p"), peak_available) + F.col("premium")
    checked = F.when(F.col("n") == F.size("lock_months"), price).otherwise(
        F.raise_error(F.concat(F.lit("lock window incomplete for "), F.col("year_local").cast("string"))).cast("double")
    )
    return grouped.select("profile", "scenario", "year_local", checked.alias("lock_price"))


def missing_index_months(spot: DataFrame, index: DataFrame, years: Sequence[int]) -> DataFrame:
    """Gate: priced months of the retrospective without an index value."""
    return spot.where(F.col("year_local").isin(*years)).join(index, ["year_local", "month_local"], "left_anti")


def monthly_costs(
    spot: DataFrame, index: DataFrame, params: DataFrame, cfg: StrategyConfig
) -> DataFrame:
    """Cost per consumer, scenario, month and strategy, long form.

    ``spot`` and ``params`` may hold any number of consumers and meet by profile; a consumer
    without parameters is an error. The index is bounded by the calendar and is broadcast.
    """
    years = list(cfg.years)
    lock = lock_prices(index, params, years, cfg.peak_available)
    listed = params.withColumn("listed", F.lit(True))
    months = (
        spot.where(F.col("year_local").isin(*years))
        .join(F.broadcast(index), ["year_local", "month_local"], "left")
        .join(listed, "profile", "left")
        .join(lock, ["profile", "scenario", "year_local"], "left")
    )
    priced = F.when(F.col("listed"), F.col("spot_cost_eur")).otherwise(
        F.raise_error(F.concat(F.lit("no strategy parameters for profile "), F.col("profile"))).cast("double")
    )
    base = F.when(F.col("oespi_base").isNotNull(), F.col("oespi_base")).otherwise(
        F.raise_error(F.lit("index missing for a priced month")).cast("double")
    )
    spot_cost, volume = priced, F.col("volume_mwh")
    fixed = volume * F.col("lock_price")
    costs = [
        ("S1", spot_cost),
        ("S2", volume * blended_price(base, F.col("oespi_peak"), cfg.peak_available)),
        ("S3", fixed),
        *[(hybrid_id(h), F.lit(h) * fixed + F.lit(1.0 - h) * spot_cost) for h in cfg.hybrid_ratios],
    ]
    long = F.array(*[F.struct(F.lit(sid).alias("strategy_id"), c.alias("cost_eur")) for sid, c in costs])
    return months.select(
        "profile", "scenario", "year_local", "month_local", "volume_mwh", F.inline(long)
    ).withColumn("unit_cost_eur_mwh", F.col("cost_eur") / F.col("volume_mwh"))


def annual_summary(costs: DataFrame, keys: Sequence[str] = (), year: str = "year_local") -> DataFrame:
    """Year x strategy: volume, cost, unit cost, distance to the cheapest, rank."""
    keys = list(keys)
    annual = costs.groupBy(*keys, F.col(year).alias("year"), "strategy_id").agg(
        F.sum("volume_mwh").alias("volume_mwh"), F.sum("cost_eur").alias("cost_eur")
    )
    cost = F.col("cost_eur")
    return annual.select(
        *keys, "year", "strategy_id", "volume_mwh", "cost_eur",
        ratio(cost, F.col("volume_mwh")).alias("unit_cost_eur_mwh"),
        above_group_min(cost, [*keys, "year"]).alias("delta_vs_min_eur"),
        rank_in_group(cost, [*keys, "year"]).alias("rank"),
    )


def wrong_strategy_cost(annual: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Dearest minus cheapest strategy per year, with both labels and the total.

    The total is a scalar subquery over the yearly rows instead of a window
    without partitions.
    """
    keys = list(keys)
    cost, sid = F.col("cost_eur"), F.col("strategy_id")
    per_year = annual.groupBy(*keys, "year").agg(
        (F.max(cost) - F.min(cost)).alias("wrong_strategy_cost_eur"),
        F.max_by(sid, F.struct(cost, sid)).alias("worst_strategy"),
        F.min_by(sid, F.struct(cost, sid)).alias("best_strategy"),
    )
    if keys:
        total = per_year.groupBy(*keys).agg(F.sum("wrong_strategy_cost_eur").alias("wrong_strategy_cost_total_eur"))
        return per_year.join(total, keys)
    total = per_year.agg(F.sum("wrong_strategy_cost_eur")).scalar()
    return per_year.withColumn("wrong_strategy_cost_total_eur", total)


def sensitivity_matrix(annual: DataFrame, cfg: StrategyConfig) -> DataFrame:
    """One row per scenario: total per strategy (EUR M), best strategy, wrong-choice total."""
    totals = annual.groupBy("scenario", "strategy_id").agg(F.sum("cost_eur").alias("cost_eur"))
    sid = F.col("strategy_id")
    wide = totals.groupBy("scenario").agg(
        *[(sum_if(sid == s, F.col("cost_eur")) / F.lit(1e6)).alias(s) for s in cfg.strategy_ids],
        F.min_by(sid, F.struct("cost_eur", "strategy_id")).alias("best"),
    )
    wrong = annual.groupBy("scenario", "year").agg((F.max("cost_eur") - F.min("cost_eur")).alias("w"))
    wrong = wrong.groupBy("scenario").agg((F.sum("w") / F.lit(1e6)).alias("wrong_strategy_cost_total_m"))
    return wide.join(wrong, "scenario")
