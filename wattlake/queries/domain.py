"""Marts, consumer load profile and retrospective strategy pricing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.config import FLAT_PROFILE, MAIN_PROFILE
from wattlake.functions.exprs import sum_if
from wattlake.operators.checks import assert_contract
from wattlake.plans import marts, profile, strategies
from wattlake.queries.feeds import Feeds
from wattlake.queries.registry import query
from wattlake.sources.schemas import MARTS


@query("d01_dim_calendar", "SELECT * FROM dimcal", "hdd_18 cdd_22")
def _(t: Feeds) -> DataFrame:
    return assert_contract(t.calendar, MARTS["dim_calendar"])


@query("d02_fct_price_hourly", "SELECT * FROM hourly",
       "price_at_eur_mwh price_delu_eur_mwh spread_at_delu_eur_mwh load_at_mw hdd_18 cdd_22")
def _(t: Feeds) -> DataFrame:
    return assert_contract(t.hourly, MARTS["fct_price_hourly"])


@query("d03_fct_price_daily", "SELECT * FROM daily",
       "price_base_eur_mwh price_peak_eur_mwh price_min price_max price_std tavg_c hdd_18 cdd_22")
def _(t: Feeds) -> DataFrame:
    return assert_contract(t.daily, MARTS["fct_price_daily"])


@query("d04_fct_price_monthly", "SELECT * FROM monthly",
       "price_base_eur_mwh price_peak_eur_mwh price_offpeak_eur_mwh oespi_base oespi_peak")
def _(t: Feeds) -> DataFrame:
    return assert_contract(t.monthly, MARTS["fct_price_monthly"])


@query("d05_fct_generation_monthly", "SELECT * FROM generation", "gen_gwh share_of_total:8")
def _(t: Feeds) -> DataFrame:
    return assert_contract(t.generation, MARTS["fct_generation_monthly"])


@query("d06_fct_consumer_load_hourly", "SELECT ts_utc, load_mwh FROM conload WHERE profile = 'main'", "load_mwh:8")
def _(t: Feeds) -> DataFrame:
    return assert_contract(marts.fct_consumer_load_hourly(t.main_load), MARTS["fct_consumer_load_hourly"])


@query("d06_fct_procurement_cost_monthly", "SELECT * FROM costs", "volume_mwh:5 cost_eur:2 unit_cost_eur_mwh")
def _(t: Feeds) -> DataFrame:
    return assert_contract(marts.fct_procurement_cost_monthly(t.costs), MARTS["fct_procurement_cost_monthly"])


@query("d07_profile_raw_weight", """
    SELECT ts_utc, CASE WHEN strftime(date_local, '%m-%d') >= '12-24' OR strftime(date_local, '%m-%d') <= '01-01' THEN 0.18::DOUBLE
                        WHEN is_holiday_at OR dow_local >= 5 THEN weekend[hour_local + 1] ELSE weekday[hour_local + 1] END
           * seasonal[month_local] * CASE WHEN date_local BETWEEN m AND m + 6 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS w
    FROM cal JOIN monday ON y = year_local CROSS JOIN shape""", "w:8")
def _(t: Feeds) -> DataFrame:
    return profile.weighted_hours(t.spine, [MAIN_PROFILE]).select("ts_utc", "w")


@query("d08_profile_yearly_normalisation", """
    SELECT profile, year_local, count(*) AS n_hours, sum(load_mwh) AS volume_mwh FROM conload GROUP BY 1, 2""", "volume_mwh:5")
def _(t: Feeds) -> DataFrame:
    return t.consumer_load.groupBy("profile", "year_local").agg(
        F.count("*").alias("n_hours"), F.sum("load_mwh").alias("volume_mwh"))


@query("d09_flat_baseload_profile", """
    SELECT ts_utc, load_mwh FROM conload WHERE profile = 'flat_baseload'""", "load_mwh:8")
def _(t: Feeds) -> DataFrame:
    return profile.hourly_load(t.spine, [FLAT_PROFILE]).select("ts_utc", "load_mwh")


@query("d10_peak_share", "SELECT * FROM peakshare", "peak_share:9")
def _(t: Feeds) -> DataFrame:
    return t.peak_share


@query("d11_monthly_spot", "SELECT * FROM spot", "volume_mwh:5 spot_cost_eur:3")
def _(t: Feeds) -> DataFrame:
    return t.spot


def segment_load(t: Feeds) -> DataFrame:
    """Many consumers: measured load per customer segment and hour."""
    stamp = F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber") * 3)
    items = t.lineitem.select("l_orderkey", stamp.alias("ts_utc"), "l_quantity")
    owners = t.orders.select("o_orderkey", "o_custkey").join(
        t.table("customer").select("c_custkey", F.col("c_mktsegment").alias("profile")),
        F.col("o_custkey") == F.col("c_custkey"))
    return items.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("profile", "ts_utc").agg(
        F.sum("l_quantity").alias("load_mwh"))


SEGMENT_HOURS = """
    SELECT l.*, h.year_local, h.month_local, h.is_peak_hour, h.price_at_eur_mwh AS p
    FROM (SELECT c_mktsegment AS profile, l_shipdate + to_hours(l_linenumber * 3) AS ts_utc, sum(l_quantity)::DOUBLE AS q
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) l
    JOIN hourly h ON h.ts_utc = l.ts_utc"""


@query("d11_monthly_spot_per_market_segment", """
    SELECT c_mktsegment AS segment, h.year_local, h.month_local, sum(q) FILTER (WHERE price_at_eur_mwh IS NOT NULL) AS volume_mwh,
           sum(q * price_at_eur_mwh) AS spot_cost_eur, count(*) FILTER (WHERE price_at_eur_mwh IS NULL) AS dropped_hours,
           count(*) FILTER (WHERE price_at_eur_mwh IS NOT NULL) AS priced_hours
    FROM (SELECT c_mktsegment, l_shipdate + to_hours(l_linenumber * 3) AS ts_utc, sum(l_quantity) AS q
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) l
    JOIN hourly h ON h.ts_utc = l.ts_utc GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE price_at_eur_mwh IS NOT NULL) > 0""",
    "volume_mwh:4 spot_cost_eur:4")
def _(t: Feeds) -> DataFrame:
    return strategies.monthly_spot(segment_load(t).withColumnRenamed("profile", "segment"), t.hourly, ["segment"])


@query("d16_costs_per_market_segment", f"""
    WITH hrs AS ({SEGMENT_HOURS}),
    par AS (SELECT r.*, w, (SELECT avg(oespi_base) FROM obs WHERE year_local = 1995) AS ob, (SELECT avg(oespi_peak) FROM obs WHERE year_local = 1995) AS op
            FROM (SELECT profile, sum(q * p) / sum(q) AS rb, avg(p) FILTER (WHERE is_peak_hour) * (sum(q * p) / sum(q)) / avg(p) AS rp
                  FROM hrs WHERE p IS NOT NULL AND year_local = 1995 GROUP BY 1) r
            JOIN (SELECT profile, sum(q) FILTER (WHERE is_peak_hour) / sum(q) AS w FROM hrs GROUP BY 1) s ON s.profile = r.profile),
    lock AS (SELECT profile, year_local + 1 AS y, rb * avg(oespi_base) / ob * (1 - w) + rp * avg(oespi_peak) / op * w + 5.0::DOUBLE AS price
             FROM par, obs WHERE month_local >= 7 GROUP BY profile, rb, rp, ob, op, w, year_local),
    mon AS (SELECT profile, year_local, month_local, sum(q) AS v, sum(q * p) AS s1 FROM hrs WHERE p IS NOT NULL AND year_local BETWEEN 1996 AND 2000 GROUP BY 1, 2, 3),
    cost AS (SELECT m.profile, m.year_local AS year, v, s1, v * (rb * oespi_base / ob * (1 - w) + rp * oespi_peak / op * w) AS s2, v * price AS s3
             FROM mon m JOIN par ON par.profile = m.profile JOIN lock ON lock.profile = m.profile AND y = m.year_local
             JOIN obs o ON o.year_local = m.year_local AND o.month_local = m.month_local)
    SELECT profile, year, sum(v) AS volume_mwh, sum(s1) AS s1_eur, sum(s2) AS s2_eur, sum(s3) AS s3_eur, sum(0.5::DOUBLE * s1 + 0.5::DOUBLE * s3) AS s4_50_eur
    FROM cost GROUP BY 1, 2""", "volume_mwh:3 s1_eur:1 s2_eur:1 s3_eur:1 s4_50_eur:1")
def _(t: Feeds) -> DataFrame:
    """Every strategy for each customer segment, with its own reference prices and peak share."""
    load, year = segment_load(t), t.cfg.reference_year
    peak = t.hourly.select("ts_utc", "is_peak_hour")
    shares = load.join(peak, "ts_utc").groupBy("profile").agg(
        (sum_if(F.col("is_peak_hour"), F.col("load_mwh")) / F.sum("load_mwh")).alias("peak_share"))
    anchors = strategies.anchors(strategies.reference_stats(load, t.hourly, year), t.observed_index, year)
    params = strategies.scenario_grid(anchors, shares, t.cfg, base_only=True)
    costs = strategies.monthly_costs(strategies.monthly_spot(load, t.hourly), t.observed_index, params, t.cfg)
    annual = strategies.annual_summary(costs, ["profile"])
    of = lambda s: F.max(F.when(F.col("strategy_id") == s, F.col("cost_eur"))).alias(f"{s.lower()}_eur")
    return annual.groupBy("profile", "year").agg(F.max("volume_mwh").alias("volume_mwh"), *[of(s) for s in ("S1", "S2", "S3", "S4_50")])


@query("d12_reference_year_stats", "SELECT * FROM refstats",
       "consumer_cost_eur:2 consumer_volume_mwh:5 mean_price_all_hours_eur_mwh mean_price_peak_eur_mwh")
def _(t: Feeds) -> DataFrame:
    return strategies.reference_stats(t.consumer_load, t.hourly, t.cfg.reference_year)


@query("d13_calibration_anchors", "SELECT * FROM anc", "p_ref_base p_ref_peak oespi_base_ref oespi_peak_ref")
def _(t: Feeds) -> DataFrame:
    return t.anchors


@query("d14_indexed_price", """
    SELECT year_local, month_local, p_ref_base * oespi_base / oespi_base_ref AS base_only_price,
           p_ref_base * oespi_base / oespi_base_ref * (1 - w_peak) + p_ref_peak * oespi_peak / oespi_peak_ref * w_peak AS price
    FROM obs CROSS JOIN (SELECT * FROM scen WHERE scenario = 'base')""", "price base_only_price")
def _(t: Feeds) -> DataFrame:
    params = t.base_params.select(F.struct("*").alias("p")).scalar()
    rows = t.observed_index.withColumn("p", params).select("year_local", "month_local", "oespi_base", "oespi_peak", "p.*")
    return rows.select(
        "year_local", "month_local",
        strategies.blended_price(F.col("oespi_base"), F.col("oespi_peak"), False).alias("base_only_price"),
        strategies.blended_price(F.col("oespi_base"), F.col("oespi_peak")).alias("price"))


@query("d15_lock_price", "SELECT * FROM locks", "lock_price")
def _(t: Feeds) -> DataFrame:
    return strategies.lock_prices(t.observed_index, t.scenarios, t.cfg.years)


@query("d16_monthly_strategy_costs", "SELECT * FROM scencosts", "volume_mwh:5 cost_eur:2 unit_cost_eur_mwh")
def _(t: Feeds) -> DataFrame:
    return t.scenario_costs


@query("d17_annual_summary", "SELECT * FROM annual",
       "volume_mwh:4 cost_eur:2 unit_cost_eur_mwh delta_vs_min_eur:2")
def _(t: Feeds) -> DataFrame:
    return strategies.annual_summary(t.costs)


@query("d17_annual_priority_cost_matrix", """
    SELECT year, strategy_id, volume_mwh, cost_eur, cost_eur / volume_mwh AS unit_cost_eur_mwh,
           cost_eur - min(cost_eur) OVER (PARTITION BY year) AS delta_vs_min_eur,
           (rank() OVER (PARTITION BY year ORDER BY cost_eur))::INT AS rank
    FROM (SELECT year(o_orderdate)::INT AS year, o_orderpriority AS strategy_id, sum(l_quantity) AS volume_mwh,
                 sum(l_extendedprice * (1 - l_discount)) AS cost_eur
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)""",
    "volume_mwh:3 cost_eur:2 unit_cost_eur_mwh:5 delta_vs_min_eur:2")
def annual_priority_costs(t: Feeds) -> DataFrame:
    orders = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year_local"),
                             F.col("o_orderpriority").alias("strategy_id"))
    costs = t.lineitem.select(
        "l_orderkey", F.col("l_quantity").alias("volume_mwh"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost_eur"),
    ).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return strategies.annual_summary(costs)


WRONG_COST = """
    SELECT year, max(cost_eur) - min(cost_eur) AS wrong_strategy_cost_eur,
           arg_max(strategy_id, cost_eur) AS worst_strategy, arg_min(strategy_id, cost_eur) AS best_strategy
    FROM {annual} GROUP BY year"""


@query("d18_wrong_strategy_cost", f"""
    SELECT *, sum(wrong_strategy_cost_eur) OVER () AS wrong_strategy_cost_total_eur FROM ({WRONG_COST.format(annual="annual")})""",
    "wrong_strategy_cost_eur:2 wrong_strategy_cost_total_eur:2")
def _(t: Feeds) -> DataFrame:
    return strategies.wrong_strategy_cost(strategies.annual_summary(t.costs))


@query("d19_sensitivity_matrix", """
    WITH a AS (SELECT scenario, year_local, strategy_id, sum(cost_eur) AS c FROM scencosts GROUP BY 1, 2, 3),
         s AS (SELECT scenario, strategy_id, sum(c) AS c FROM a GROUP BY 1, 2),
         w AS (SELECT scenario, sum(x) / 1e6 AS wrong FROM (SELECT scenario, year_local, max(c) - min(c) AS x FROM a GROUP BY 1, 2) GROUP BY 1)
    SELECT s.scenario, sum(c) FILTER (WHERE strategy_id = 'S1') / 1e6 AS S1, sum(c) FILTER (WHERE strategy_id = 'S2') / 1e6 AS S2,
           sum(c) FILTER (WHERE strategy_id = 'S3') / 1e6 AS S3, sum(c) FILTER (WHERE strategy_id = 'S4_30') / 1e6 AS S4_30,
           sum(c) FILTER (WHERE strategy_id = 'S4_50') / 1e6 AS S4_50, sum(c) FILTER (WHERE strategy_id = 'S4_70') / 1e6 AS S4_70,
           arg_min(strategy_id, c) AS best, any_value(wrong) AS wrong_strategy_cost_total_m
    FROM s JOIN w ON w.scenario = s.scenario GROUP BY 1""",
    "S1 S2 S3 S4_30 S4_50 S4_70 wrong_strategy_cost_total_m")
def _(t: Feeds) -> DataFrame:
    annual = strategies.annual_summary(t.scenario_costs, ["scenario"])
    return strategies.sensitivity_matrix(annual, t.cfg)
