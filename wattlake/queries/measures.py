"""Measures of the dashboard layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.plans import measures
from wattlake.queries.feeds import Feeds
from wattlake.queries.registry import query
from wattlake.queries.windows import NUMBERS, numbers


def strategy_labels(t: Feeds) -> DataFrame:
    rows = [(sid, f"Strategy {sid}", i) for i, sid in enumerate(t.cfg.strategy_ids, start=1)]
    return t.spark.createDataFrame(rows, "strategy_id string, strategy_label string, sort_order int")


@query("m01_cost_totals", """
    SELECT year_local, strategy_id, sum(cost_eur) AS total_cost_eur, sum(volume_mwh) AS total_volume_mwh, sum(cost_eur) / sum(volume_mwh) AS unit_cost_eur_per_mwh
    FROM costs GROUP BY 1, 2""", "total_cost_eur:2 total_volume_mwh:4 unit_cost_eur_per_mwh")
def _(t: Feeds) -> DataFrame:
    return measures.cost_totals(t.costs, ["year_local", "strategy_id"])


@query("m01_price_averages", """
    SELECT year_local, avg(price_base_eur_mwh) AS avg_base_price, avg(price_peak_eur_mwh) AS avg_peak_price, avg(price_offpeak_eur_mwh) AS avg_offpeak_price,
           sum(n_negative_hours)::BIGINT AS negative_price_hours FROM monthly GROUP BY 1""", "avg_base_price avg_peak_price avg_offpeak_price")
def _(t: Feeds) -> DataFrame:
    return measures.price_averages(t.monthly, ["year_local"])


@query("m02_wrong_strategy_cost", """
    SELECT sum(gap) AS wrong_strategy_cost_eur FROM (SELECT year, max(cost_eur) - min(cost_eur) AS gap FROM annual GROUP BY 1)""", "wrong_strategy_cost_eur:2")
def _(t: Feeds) -> DataFrame:
    return measures.wrong_strategy_cost(t.costs)


@query("m03_cheapest_strategy", """
    SELECT year AS year_local, 'Strategy ' || strategy_id AS cheapest_strategy FROM annual
    QUALIFY row_number() OVER (PARTITION BY year ORDER BY cost_eur, strategy_id) = 1""")
def _(t: Feeds) -> DataFrame:
    return measures.cheapest_strategy(t.costs, strategy_labels(t), ["year_local"])


@query("m04_cost_vs_cheapest", """
    SELECT strategy_id, c AS total_cost_eur, c - min(c) OVER () AS cost_vs_cheapest_eur FROM (SELECT strategy_id, sum(cost_eur) AS c FROM costs GROUP BY 1)""",
    "total_cost_eur:2 cost_vs_cheapest_eur:2")
def _(t: Feeds) -> DataFrame:
    return measures.cost_vs_cheapest(t.costs)


@query("m05_cumulative_cost", """
    SELECT * FROM (SELECT strategy_id, year_local, month_local, cost_eur, sum(cost_eur) OVER (PARTITION BY strategy_id ORDER BY year_local, month_local) AS cumulative_cost_eur FROM costs)
    WHERE make_date(year_local, month_local, 1) BETWEEN DATE '1998-01-01' AND DATE '1999-06-01'""", "cost_eur:2 cumulative_cost_eur:2")
def _(t: Feeds) -> DataFrame:
    return measures.cumulative_cost(t.costs, "1998-01-01", "1999-06-01")


@query("m06_forward_metrics", """
    SELECT strategy_id, avg(mean) AS forward_mean_eur, avg(p5) AS forward_p5_eur, avg(p50) AS forward_p50_eur, avg(p95) AS forward_p95_eur,
           avg(cvar95) AS forward_cvar95_eur, avg(p95) - avg(p50) AS tail_spread_eur FROM risksum WHERE variant = 'unconditional' GROUP BY 1""",
    "forward_mean_eur:1 forward_p5_eur:1 forward_p50_eur:1 forward_p95_eur:1 forward_cvar95_eur:1 tail_spread_eur:1")
def _(t: Feeds) -> DataFrame:
    return measures.forward_metrics(t.risk_summary, keys=["strategy_id"])


@query("m07_path_measures", """
    SELECT strategy_id, count(*) AS paths, sum(cost_eur) / 1e6 AS path_cost_eur_million FROM pathcosts WHERE variant = 'no_crisis' GROUP BY 1""", "path_cost_eur_million:4")
def _(t: Feeds) -> DataFrame:
    return measures.path_measures(t.path_costs, "no_crisis", ["strategy_id"])


@query("m08_quality_measures", """
    SELECT year_local, sum(expected_hours)::BIGINT AS expected_hours, sum(priced_hours_at)::BIGINT AS priced_hours_at,
           sum(priced_hours_at)::DOUBLE / sum(expected_hours) * 100 AS price_coverage_pct, count(*) FILTER (WHERE coverage_at_pct < 100) AS months_below_full_coverage,
           sum(n_dst_days)::BIGINT AS dst_days, sum(n_hours_from_pt15m)::BIGINT AS hours_from_15min_quarters, count(*) FILTER (WHERE NOT has_oespi) AS months_missing_index
    FROM dq GROUP BY 1""", "price_coverage_pct")
def _(t: Feeds) -> DataFrame:
    return measures.quality_measures(t.dq, ["year_local"])


@query("m09_number_lookup", f"""
    SELECT key, value, unit, CASE WHEN unit NOT IN ('strategy_id', 'month', 'months') THEN try_cast(value AS DOUBLE) END AS number FROM ({NUMBERS})
    WHERE key IN ('best_strategy_5yr', 'wrong_strategy_cost_1998', 'neg_hours_1999')""")
def _(t: Feeds) -> DataFrame:
    return measures.number_lookup(numbers(t), ["best_strategy_5yr", "wrong_strategy_cost_1998", "neg_hours_1999"])


@query("m10_date_table", """
    SELECT d AS date, year(d)::INT AS year, month(d)::INT AS month, date_trunc('month', d)::DATE AS month_start FROM (
        SELECT unnest(generate_series(min(o_orderdate)::DATE, last_day((max(o_orderdate)::DATE + INTERVAL 12 MONTH)::DATE), INTERVAL 1 DAY))::DATE AS d FROM orders)""")
def _(t: Feeds) -> DataFrame:
    day = F.to_date("o_orderdate")
    return measures.date_table(t.orders.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day")))


@query("m12_monthly_market_payload", """
    SELECT printf('%04d-%02d', m.year_local, m.month_local) AS month, price_base_eur_mwh AS base, price_peak_eur_mwh AS peak, spread_mean_eur_mwh AS spread
    FROM monthly m LEFT JOIN spreadmonthly s ON s.year_local = m.year_local AND s.month_local = m.month_local""", "base peak spread")
def _(t: Feeds) -> DataFrame:
    return measures.monthly_market_payload(t.monthly, t.spread)


@query("m12_yearly_negative_hours", """
    SELECT year_local, sum(n_negative_hours)::BIGINT AS neg_hours, count(*) < 12 AS is_partial FROM monthly GROUP BY 1""")
def _(t: Feeds) -> DataFrame:
    return measures.yearly_negative_hours(t.monthly)
