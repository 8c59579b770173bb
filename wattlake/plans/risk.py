"""Forward cost distribution by seasonal block bootstrap.

Monthly costs are additive, so each (target month, pool year) cell is priced
once and a path only sums drawn cells. Cells are a few hundred numbers; they
travel to the paths as one array row per variant. A path is then a map-only
computation: no join per month, no shuffle, any number of paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlake.config import StrategyConfig, hybrid_id
from wattlake.functions.hashing import draw_word, uniform_index, word_index
from wattlake.functions.timecols import month_of
from wattlake.operators.joins import fill_in_order
from wattlake.operators.quantiles import describe_groups, group_mode
from wattlake.plans.strategies import blended_price


def target_months(last_month: DataFrame, horizon: int) -> DataFrame:
    """The ``horizon`` months after the last priced one: ``target_idx, year_local, month_local``."""
    start, end = F.add_months("last_month", 1), F.add_months("last_month", horizon)
    months = F.sequence(start, end, F.expr("interval 1 month"))
    return last_month.select(F.posexplode(months).alias("target_idx", "m")).select(
        "target_idx", F.year("m").alias("year_local"), F.month("m").alias("month_local")
    )


def last_priced_month(price_monthly: DataFrame) -> DataFrame:
    """One row; a top-1 sort, so nothing but one row per task moves."""
    return (
        price_monthly.where(F.col("price_base_eur_mwh").isNotNull())
        .orderBy(F.col("year_local").desc(), F.col("month_local").desc())
        .limit(1)
        .select(month_of(F.col("year_local"), F.col("month_local")).alias("last_month"))
    )


def december_regimes(regimes: DataFrame) -> DataFrame:
    """Most frequent regime of each December, smallest label on ties."""
    december = regimes.where(F.month("date_local") == 12).withColumn("year_local", F.year("date_local"))
    return group_mode(december, ["year_local"], "regime", "regime")


def bootstrap_pool(index: DataFrame, excluded: DataFrame | None, cfg: StrategyConfig) -> DataFrame:
    """``variant, month_local, pool_year, pool_idx, n_pool``.

    ``excluded`` holds the ``year_local`` values that only the second variant
    leaves out.
    """
    full, reduced = cfg.variants
    months = index.select("month_local", F.col("year_local").alias("pool_year"))
    pool = months.withColumn("variant", F.lit(full))
    rest = months.withColumn("variant", F.lit(reduced))
    if excluded is not None:
        rest = rest.join(excluded.select(F.col("year_local").alias("pool_year")), "pool_year", "left_anti")
    w = Window.partitionBy("variant", "month_local")
    return pool.unionByName(rest).select(
        "variant", "month_local", "pool_year",
        (F.row_number().over(w.orderBy("pool_year")) - 1).alias("pool_idx"),
        F.count("*").over(w).cast("int").alias("n_pool"),
    )


def _day_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "*", F.dayofmonth("date_local").alias("day_local"),
        (F.col("is_weekend") | F.col("is_holiday_at")).alias("is_free_day"),
    )


def align_hours(target_load: DataFrame, price_hourly: DataFrame, targets: DataFrame, pool_years: DataFrame) -> DataFrame:
    """Prices of every pool month laid over the hours of its target month.

    Key: (day of month, local hour), duplicated autumn hours averaged. Days
    beyond the drawn month reuse its last day of the same type; an hour still
    missing is filled forward, then backward, in target order.
    """
    priced = _day_columns(price_hourly.where(F.col("price_at_eur_mwh").isNotNull()))
    drawn = priced.groupBy(
        F.col("year_local").alias("pool_year"), "month_local",
        F.col("day_local").alias("src_day"), "hour_local",
    ).agg(F.avg("price_at_eur_mwh").alias("price"))
    shape = priced.groupBy(F.col("year_local").alias("pool_year"), "month_local").agg(
        F.max("day_local").alias("n_days"),
        F.max(F.when(F.col("is_free_day"), F.col("day_local"))).alias("last_free"),
        F.max(F.when(~F.col("is_free_day"), F.col("day_local"))).alias("last_work"),
    )
    # Bounded by horizon and history: 745 hours per target month and pool year.
    hours = _day_columns(target_load).join(F.broadcast(targets), ["year_local", "month_local"]).select(
        "target_idx", F.col("year_local").alias("delivery_year"), "month_local", "ts_utc",
        "day_local", "hour_local", "is_free_day", "load_mwh",
    )
    fan = hours.join(pool_years.join(shape, ["pool_year", "month_local"]), "month_local")
    last_of_type = F.when(F.col("is_free_day"), F.coalesce("last_free", "n_days")).otherwise(
        F.coalesce("last_work", "n_days")
    )
    src = F.when(F.col("day_local") <= F.col("n_days"), F.col("day_local")).otherwise(last_of_type)
    keyed = fan.withColumn("src_day", src).join(
        drawn, ["pool_year", "month_local", "src_day", "hour_local"], "left"
    )
    filled = fill_in_order(keyed, ["target_idx", "pool_year"], "ts_utc", "price")
    return filled.select(
        "target_idx", "delivery_year", "month_local", "pool_year", "ts_utc", "hour_local",
        "day_local", "src_day", "load_mwh", "price",
    )


def price_cells(target_load: DataFrame, price_hourly: DataFrame, index: DataFrame, targets: DataFrame, pool: DataFrame) -> DataFrame:
    """``variant, target_idx, pool_idx`` with spot cost, volume and the drawn index pair."""
    pool_years = pool.select("month_local", "pool_year").distinct()
    aligned = align_hours(target_load, price_hourly, targets, pool_years)
    priced = aligned.groupBy("target_idx", "delivery_year", "month_local", "pool_year").agg(
        F.sum(F.col("load_mwh") * F.col("price")).alias("spot_cost_eur"),
        F.sum("load_mwh").alias("volume_mwh"),
    )
    pair = index.select(
        F.col("year_local").alias("pool_year"), "month_local", "oespi_base", "oespi_peak"
    )
    return priced.join(pair, ["pool_year", "month_local"]).join(pool, ["pool_year", "month_local"]).select(
        "variant", "target_idx", "delivery_year", "month_local", "pool_year", "pool_idx", "n_pool",
        "spot_cost_eur", "volume_mwh", "oespi_base", "oespi_peak",
    )


def draws(paths: DataFrame, cells: DataFrame, seed: int) -> DataFrame:
    """Drawn pool index per path and target month (inspection form of the draw)."""
    sizes = cells.select("variant", "target_idx", "n_pool").distinct()
    slots = sizes.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("target_idx", "n_pool"))).alias("t"))
    one = slots.agg(F.collect_list(F.struct("variant", "t"))).scalar()
    rows = paths.select("path", F.inline(one)).select("path", "variant", F.inline("t"))
    return rows.withColumn(
        "pool_idx", uniform_index(seed, [F.col("path"), F.col("target_idx")], F.col("n_pool"))
    )


def lock_slots(index: DataFrame, targets: DataFrame, lock_months: tuple[int, ...]) -> DataFrame:
    """Index source of each lock month: observed value, else target month, else last observed."""
    last = index.agg(
        F.max_by(F.struct("oespi_base", "oespi_peak"), F.struct("year_local", "month_local")).alias("l")
    ).scalar()
    years = targets.select(F.col("year_local").alias("delivery_year")).distinct()
    slots = years.select(
        "delivery_year", (F.col("delivery_year") - 1).alias("year_local"),
        F.explode(F.array(*[F.lit(m) for m in lock_months])).alias("month_local"),
    )
    keyed = slots.join(index, ["year_local", "month_local"], "left").join(
        targets, ["year_local", "month_local"], "left"
    )
    return keyed.withColumn("l", last).select(
        "delivery_year", "year_local", "month_local",
        F.col("oespi_base").alias("obs_base"), F.col("oespi_peak").alias("obs_peak"),
        "target_idx", F.col("l.oespi_base").alias("last_base"), F.col("l.oespi_peak").alias("last_peak"),
    )


#: Simulated paths of one task.
PATHS_PER_TASK = 2_000


def _variant_rows(cells: DataFrame, slots: DataFrame) -> DataFrame:
    """One row per variant: target array (with its cell array) and delivery-year array."""
    cell = F.struct("pool_idx", "spot_cost_eur", "oespi_base", "oespi_peak")
    by_target = cells.groupBy("variant", "target_idx", "delivery_year", "volume_mwh").agg(
        F.array_sort(F.collect_list(cell)).alias("cells")
    )
    target = F.struct("target_idx", "delivery_year", "volume_mwh", "cells")
    per_variant = by_target.groupBy("variant").agg(F.array_sort(F.collect_list(target)).alias("targets"))
    slot = F.struct("month_local", "obs_base", "obs_peak", "target_idx", "last_base", "last_peak")
    per_year = slots.groupBy("delivery_year").agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    years = per_year.agg(F.array_sort(F.collect_list(F.struct("delivery_year", "slots")))).scalar()
    return per_variant.withColumn("years", years)


def path_totals(paths: DataFrame, cells: DataFrame, slots: DataFrame, params: DataFrame, cfg: StrategyConfig) -> DataFrame:
    """``variant, path, s1, s2, s3``: what spot, index and fixed price cost on each path over the horizon.

    ``paths`` has one column ``path``; ``params`` one row of price parameters.
    The side arrays hold horizon x pool-years cells (about a hundred structs).
    The words of a path's draws are the same in every variant and are hashed once.
    """
    shared = _variant_rows(cells, slots)
    sides = shared.agg(F.collect_list(F.struct("variant", "targets", "years"))).scalar()
    price = params.select(F.struct(
        "p_ref_base", "p_ref_peak", "oespi_base_ref", "oespi_peak_ref", "w_peak", "premium"
    ).alias("price")).scalar()
    # Eight bytes per path against a whole simulated year: file sizes say nothing about
    # the work, so the number of paths decides how many tasks share it.
    spread = paths.select("path").repartition(-(-paths.count() // PATHS_PER_TASK) or 1, "path")
    words = F.array(*[draw_word(cfg.seed, [F.col("path"), F.lit(i)]) for i in range(cfg.horizon_months)])
    rows = spread.select("path", words.alias("words")).select("path", "words", F.inline(sides))
    rows = rows.withColumn("price", price).select("path", "words", "variant", "targets", "years", "price.*")

    complete = F.when(F.size("targets") == cfg.horizon_months, F.col("targets")).otherwise(
        F.raise_error(F.concat(F.lit("empty bootstrap pool in variant "), F.col("variant"))).cast(
            shared.schema["targets"].dataType)
    )

    def pick(t: Column) -> Column:
        index = word_index(F.get("words", t["target_idx"]), F.size(t["cells"]))
        return F.struct(t["target_idx"].alias("target_idx"), t["delivery_year"].alias("delivery_year"),
                        t["volume_mwh"].alias("volume_mwh"), F.get(t["cells"], index).alias("cell"))

    picked = rows.withColumn("picks", F.transform(complete, pick)).drop("targets", "words")

    def total(array: Column | str, term) -> Column:  # noqa: ANN001
        return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + term(x))

    def slot_value(slot: Column, leg: str) -> Column:
        drawn = F.get(F.col("picks"), slot["target_idx"])["cell"][f"oespi_{leg}"]
        return F.coalesce(slot[f"obs_{leg}"], drawn, slot[f"last_{leg}"])

    def lock_cost(year: Column) -> Column:
        n = F.size(year["slots"])
        base = total(year["slots"], lambda s: slot_value(s, "base")) / n
        peak = total(year["slots"], lambda s: slot_value(s, "peak")) / n
        volume = total(
            F.filter("picks", lambda p: p["delivery_year"] == year["delivery_year"]), lambda p: p["volume_mwh"]
        )
        return volume * (blended_price(base, peak, cfg.peak_available) + F.col("premium"))

    return picked.select(
        "variant", "path",
        total("picks", lambda p: p["cell"]["spot_cost_eur"]).alias("s1"),
        total("picks", lambda p: p["volume_mwh"] * blended_price(
            p["cell"]["oespi_base"], p["cell"]["oespi_peak"], cfg.peak_available)).alias("s2"),
        total("years", lock_cost).alias("s3"),
    )


def strategy_costs(totals: DataFrame, cfg: StrategyConfig) -> DataFrame:
    """``variant, path, strategy_id, cost_eur`` of every strategy, from the three costs of ``path_totals``."""
    costs = [
        ("S1", F.col("s1")), ("S2", F.col("s2")), ("S3", F.col("s3")),
        *[(hybrid_id(h), F.lit(h) * F.col("s3") + F.lit(1.0 - h) * F.col("s1")) for h in cfg.hybrid_ratios],
    ]
    long = F.array(*[F.struct(F.lit(s).alias("strategy_id"), c.alias("cost_eur")) for s, c in costs])
    return totals.select("variant", "path", F.inline(long))


def path_costs(paths: DataFrame, cells: DataFrame, slots: DataFrame, params: DataFrame, cfg: StrategyConfig) -> DataFrame:
    """Total cost per variant, path and strategy over the horizon (long form)."""
    return strategy_costs(path_totals(paths, cells, slots, params, cfg), cfg)


def risk_summary(paths: DataFrame) -> DataFrame:
    """Mean, deviation, P5/P50/P95 and the mean of the worst 5 % per variant and strategy."""
    out = describe_groups(
        paths, ["variant", "strategy_id"], "cost_eur", {"p5": 0.05, "p50": 0.50, "p95": 0.95},
        tail_share=0.05, tail_name="cvar95",
    )
    return out.select("variant", "strategy_id", "mean", "std", "p5", "p50", "p95", "cvar95")


def recommendation(summary: DataFrame, variant: str = "unconditional") -> DataFrame:
    """Cheapest on average, cheapest in the tail, and the price of the protection."""
    rows = summary.where(F.col("variant") == variant)
    row = F.struct("strategy_id", "mean", "p95")
    best = rows.agg(
        F.min_by(row, F.struct("mean", "strategy_id")).alias("c"),
        F.min_by(row, F.struct("p95", "strategy_id")).alias("r"),
    )
    return best.select(
        F.col("c.strategy_id").alias("cost_min_strategy"),
        F.col("r.strategy_id").alias("risk_averse_strategy"),
        (F.col("r.mean") - F.col("c.mean")).alias("risk_premium_eur"),
        (F.col("c.p95") - F.col("r.p95")).alias("p95_reduction_eur"),
    )
