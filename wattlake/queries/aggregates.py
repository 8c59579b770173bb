"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.config import FLAT_PROFILE, MAIN_PROFILE
from wattlake.functions.exprs import avg_if, ratio, share_if
from wattlake.operators import quantiles
from wattlake.operators.spine import integer_spine
from wattlake.plans import analytics, profile, staging
from wattlake.queries.feeds import Feeds
from wattlake.queries.registry import query


@query("a01_hourly_mean_of_subhours", """
    SELECT date_trunc('hour', ts) AS ts_utc, event_type AS zone, avg(value) AS value, count(*) AS n_subhours FROM events GROUP BY 1, 2""", "value:7")
def _(t: Feeds) -> DataFrame:
    ticks = t.events.select(F.col("ts").alias("ts_utc"), F.col("event_type").alias("zone"), "value")
    return staging.hourly_mean(ticks, "value", ["zone"], "n_subhours").select("ts_utc", "zone", "value", "n_subhours")


@query("a01_hourly_prices", "SELECT zone, ts_utc, price_eur_mwh, n_subhours FROM prices", "price_eur_mwh")
def _(t: Feeds) -> DataFrame:
    return t.prices


@query("a02_hourly_generation_by_type", "SELECT * FROM gen", "gen_mw")
def _(t: Feeds) -> DataFrame:
    return staging.hourly_generation(t.raw_gen)


@query("a03_daily_statistics", """
    SELECT o_orderdate::DATE AS day, avg(o_totalprice / 977.0) AS mean, min(o_totalprice / 977.0) AS low,
           max(o_totalprice / 977.0) AS high, stddev_samp(o_totalprice / 977.0) AS std FROM orders GROUP BY 1""", "mean low high std")
def _(t: Feeds) -> DataFrame:
    p = F.col("o_totalprice") / 977.0
    return t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.avg(p).alias("mean"), F.min(p).alias("low"), F.max(p).alias("high"), F.stddev_samp(p).alias("std"))


@query("a04_filtered_aggregates", """
    SELECT l_linestatus, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS mean_returned,
           count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted, sum(l_quantity) FILTER (WHERE l_tax > 0.9) AS none
    FROM lineitem GROUP BY 1""", "mean_returned:4 none")
def _(t: Feeds) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus").agg(
        avg_if(F.col("l_returnflag") == "R", F.col("l_extendedprice")).alias("mean_returned"),
        F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"),
        F.sum(F.when(F.col("l_tax") > 0.9, F.col("l_quantity"))).alias("none"))


@query("a05_count_distinct", """
    SELECT year_local, month_local, count(DISTINCT date_local) AS days, count(DISTINCT hour_local) AS hours FROM cal GROUP BY 1, 2""")
def _(t: Feeds) -> DataFrame:
    return t.calendar.groupBy("year_local", "month_local").agg(
        F.count_distinct("date_local").alias("days"), F.count_distinct("hour_local").alias("hours"))


@query("a06_two_level_dst_days", """
    SELECT year_local, month_local, count(*) AS n_dst_days FROM (
        SELECT year_local, month_local, date_local FROM cal GROUP BY 1, 2, 3 HAVING count(*) <> 24) GROUP BY 1, 2""")
def _(t: Feeds) -> DataFrame:
    days = t.calendar.groupBy("year_local", "month_local", "date_local").agg(F.count("*").alias("h"))
    return days.where("h <> 24").groupBy("year_local", "month_local").agg(F.count("*").alias("n_dst_days"))


@query("a07_bool_or", """
    SELECT o_custkey, bool_or(o_totalprice > 490000) AS any_large, bool_or(o_orderstatus = 'P') AS any_pending FROM orders GROUP BY 1""")
def _(t: Feeds) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(
        F.bool_or(F.col("o_totalprice") > 490000).alias("any_large"),
        F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"))


@query("a08_arg_max_arg_min", """
    SELECT c AS o_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1) AS dearest,
           (SELECT o_orderkey FROM orders WHERE o_custkey = c ORDER BY o_totalprice, o_orderkey LIMIT 1) AS cheapest
    FROM (SELECT DISTINCT o_custkey AS c FROM orders)""")
def _(t: Feeds) -> DataFrame:
    order = F.struct("o_totalprice", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(
        F.max_by("o_orderkey", order).alias("dearest"), F.min_by("o_orderkey", order).alias("cheapest"))


@query("a09_group_range", "SELECT o_orderpriority, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY 1", "spread:2")
def _(t: Feeds) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg((F.max("o_totalprice") - F.min("o_totalprice")).alias("spread"))


@query("a10_having_on_aggregates", """
    SELECT l_suppkey, count(*) AS n, min(l_shipdate)::DATE AS first_day, max(l_shipdate)::DATE AS last_day FROM lineitem
    GROUP BY 1 HAVING count(*) FILTER (WHERE l_quantity > 48) > 10 AND min(l_shipdate) < TIMESTAMP '1995-02-01'""")
def _(t: Feeds) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.to_date(F.min("l_shipdate")).alias("first_day"),
        F.to_date(F.max("l_shipdate")).alias("last_day"), F.count_if(F.col("l_quantity") > 48).alias("large"))
    return g.where((F.col("large") > 10) & (F.col("first_day") < "1995-02-01")).drop("large")


@query("a11_median_per_year", """
    SELECT year_local, median(price_at_eur_mwh) AS median FROM hourly WHERE price_at_eur_mwh IS NOT NULL GROUP BY 1""", "median")
def _(t: Feeds) -> DataFrame:
    # A year of one hourly series is bounded, so the built-in exact median is safe.
    return analytics.priced_hours(t.hourly).groupBy("year_local").agg(F.median("price_at_eur_mwh").alias("median"))


@query("a11_median_of_unbounded_groups", """
    SELECT event_type, count(*) AS n, median(value) AS median FROM events GROUP BY 1""", "median:4")
def _(t: Feeds) -> DataFrame:
    out = quantiles.describe_groups(t.events, ["event_type"], "value", {"median": 0.5})
    return out.select("event_type", "n", "median")


@query("a12_quantiles_of_unbounded_groups", """
    SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, 0.05) AS p5, quantile_cont(l_extendedprice, 0.5) AS p50,
           quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1""", "p5:4 p50:4 p95:4")
def _(t: Feeds) -> DataFrame:
    out = quantiles.describe_groups(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    return out.select("l_returnflag", "n", "p5", "p50", "p95")


@query("a13_weighted_sum", """
    SELECT l_suppkey, sum(l_quantity * l_extendedprice) AS cost FROM lineitem GROUP BY 1""", "cost:1")
def _(t: Feeds) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.sum(F.col("l_quantity") * F.col("l_extendedprice")).alias("cost"))


@query("a14_ratio_of_sums", """
    SELECT year_local AS year, sum(priced_hours_at)::BIGINT AS priced_hours, sum(expected_hours)::BIGINT AS calendar_hours,
           round(100.0::DOUBLE * sum(priced_hours_at) / sum(expected_hours), 2) AS coverage_pct,
           sum(n_dst_days)::BIGINT AS dst_days, sum(n_hours_from_pt15m)::BIGINT AS hours_from_15min_quarters,
           sum(n_negative_hours)::BIGINT AS negative_price_hours FROM dq GROUP BY 1""")
def _(t: Feeds) -> DataFrame:
    return t.dq.groupBy(F.col("year_local").alias("year")).agg(
        F.sum("priced_hours_at").alias("priced_hours"), F.sum("expected_hours").alias("calendar_hours"),
        F.round(F.lit(100.0) * ratio(F.sum("priced_hours_at"), F.sum("expected_hours")), 2).alias("coverage_pct"),
        F.sum("n_dst_days").alias("dst_days"), F.sum("n_hours_from_pt15m").alias("hours_from_15min_quarters"),
        F.sum("n_negative_hours").alias("negative_price_hours"))


@query("a15_share_of_boolean", """
    SELECT o_orderpriority, avg(CASE WHEN o_totalprice > 250000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM orders GROUP BY 1""", "share:8")
def _(t: Feeds) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(share_if(F.col("o_totalprice") > 250000).alias("share"))


@query("a16_conditional_mean_depth", """
    SELECT year_local, coalesce(-avg(price_at_eur_mwh) FILTER (WHERE price_at_eur_mwh < 0), 0.0::DOUBLE) AS depth FROM hourly GROUP BY 1""", "depth")
def _(t: Feeds) -> DataFrame:
    p = F.col("price_at_eur_mwh")
    return t.hourly.groupBy("year_local").agg(F.coalesce(-avg_if(p < 0, p), F.lit(0.0)).alias("depth"))


@query("a17_mean_absolute_value", "SELECT regime, avg(abs(d_t)) AS mean_abs FROM labelled GROUP BY 1", "mean_abs")
def _(t: Feeds) -> DataFrame:
    return t.labelled.groupBy("regime").agg(F.avg(F.abs("d_t")).alias("mean_abs"))


@query("a18_mode_smallest_on_ties", """
    SELECT o_custkey, o_orderpriority AS mode FROM (
        SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn
        FROM orders GROUP BY 1, 2) WHERE rn = 1""")
def _(t: Feeds) -> DataFrame:
    return quantiles.group_mode(t.orders, ["o_custkey"], "o_orderpriority")


@query("a19_min_max_bounds", "SELECT * FROM pricewindow")
def _(t: Feeds) -> DataFrame:
    from wattlake.plans.marts import priced_window

    return priced_window(t.hourly)


_GRID = ", ".join(f"avg(price_at_eur_mwh) FILTER (WHERE month_local = {m}) AS m{m}" for m in range(1, 13))


@query("a20_hour_month_grid", f"""
    SELECT y AS year_local, h::INT AS hour_local, g.* EXCLUDE (year_local, hour_local)
    FROM (SELECT DISTINCT year_local AS y FROM hourly WHERE price_at_eur_mwh IS NOT NULL) CROSS JOIN (SELECT unnest(range(24)) AS h)
    LEFT JOIN (SELECT year_local, hour_local, {_GRID} FROM hourly WHERE price_at_eur_mwh IS NOT NULL GROUP BY 1, 2) g
        ON g.year_local = y AND g.hour_local = h""", " ".join(f"m{m}" for m in range(1, 13)))
def _(t: Feeds) -> DataFrame:
    return analytics.hour_month_grid(t.hourly)


@query("a21_pivot_strategies_years", """
    SELECT strategy_id, sum(cost_eur) FILTER (WHERE year = 1996) AS y1996, sum(cost_eur) FILTER (WHERE year = 1997) AS y1997,
           sum(cost_eur) FILTER (WHERE year = 1998) AS y1998, sum(cost_eur) FILTER (WHERE year = 1999) AS y1999,
           sum(cost_eur) FILTER (WHERE year = 2000) AS y2000 FROM annual GROUP BY 1""", "y1996:2 y1997:2 y1998:2 y1999:2 y2000:2")
def _(t: Feeds) -> DataFrame:
    from wattlake.plans import strategies

    wide = analytics.strategy_by_year(strategies.annual_summary(t.costs), t.cfg.years)
    return wide.select("strategy_id", *[F.col(f"`{y}`").alias(f"y{y}") for y in t.cfg.years])


@query("a22_matrix_with_row_totals", """
    SELECT strategy_id, year_local, sum(cost_eur) AS cost_eur, sum(cost_eur) / sum(volume_mwh) AS unit_cost_eur_mwh,
           grouping(year_local)::INT AS is_total FROM costs GROUP BY GROUPING SETS ((strategy_id, year_local), (strategy_id))""",
    "cost_eur:2 unit_cost_eur_mwh")
def _(t: Feeds) -> DataFrame:
    return analytics.strategy_year_matrix(t.costs)


HISTOGRAM = """
    SELECT g.{k}, b AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT {k} FROM {t}) g
    CROSS JOIN (SELECT unnest(range((SELECT min(floor({v} / {w}))::BIGINT FROM {t}), (SELECT max(floor({v} / {w}))::BIGINT + 1 FROM {t}))) AS b)
    LEFT JOIN (SELECT {k}, floor({v} / {w})::BIGINT AS bin, count(*) AS n FROM {t} GROUP BY 1, 2) h ON h.{k} = g.{k} AND h.bin = b"""


@query("a23_zero_filled_histogram", HISTOGRAM.format(k="o_orderpriority", v="o_totalprice", w="10000.0::DOUBLE", t="orders"))
def _(t: Feeds) -> DataFrame:
    return quantiles.histogram(t.orders, ["o_orderpriority"], "o_totalprice", 10000.0)


@query("a24_box_statistics", """
    SELECT strategy_id, quantile_cont(cost_eur, 0.05) AS p5, quantile_cont(cost_eur, 0.25) AS p25, quantile_cont(cost_eur, 0.5) AS p50,
           quantile_cont(cost_eur, 0.75) AS p75, quantile_cont(cost_eur, 0.95) AS p95 FROM costs GROUP BY 1""",
    "p5:2 p25:2 p50:2 p75:2 p95:2")
def _(t: Feeds) -> DataFrame:
    return analytics.box_stats(t.costs, ["strategy_id"], "cost_eur")


@query("a25_negative_hours_by_hour_of_day", """
    SELECT h::INT AS hour_local, coalesce(n, 0) AS n FROM (SELECT unnest(range(24)) AS h)
    LEFT JOIN (SELECT hour_local, count(*) AS n FROM hourly WHERE price_at_eur_mwh < 0 GROUP BY 1) ON hour_local = h""")
def _(t: Feeds) -> DataFrame:
    return analytics.negative_hours_by_hour(t.hourly)


@query("a25_returns_by_line_zero_filled", """
    SELECT l::INT AS l_linenumber, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS l)
    LEFT JOIN (SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_linenumber = l""")
def _(t: Feeds) -> DataFrame:
    counts = t.lineitem.where("l_returnflag = 'R'").groupBy("l_linenumber").agg(F.count("*").alias("n"))
    axis = integer_spine(0, 9, "l_linenumber", t.lineitem)
    return axis.join(counts, "l_linenumber", "left").select("l_linenumber", F.coalesce("n", F.lit(0)).alias("n"))


@query("a26_two_condition_share", """
    SELECT year_local, count(*) FILTER (WHERE price_at_eur_mwh < 0 AND month_local BETWEEN 4 AND 9 AND hour_local BETWEEN 10 AND 16)::DOUBLE
           / nullif(count(*) FILTER (WHERE price_at_eur_mwh < 0), 0) AS solar_share FROM hourly GROUP BY 1""", "solar_share:8")
def _(t: Feeds) -> DataFrame:
    negative = F.col("price_at_eur_mwh") < 0
    solar = F.col("month_local").between(4, 9) & F.col("hour_local").between(10, 16)
    return t.hourly.groupBy("year_local").agg(
        ratio(F.count_if(negative & solar), F.count_if(negative)).alias("solar_share"))


@query("a27_threshold_counts", """
    SELECT event_type, count(*) FILTER (WHERE value > 100) AS above_100, count(*) FILTER (WHERE value > 300) AS above_300 FROM events GROUP BY 1""")
def _(t: Feeds) -> DataFrame:
    return t.events.groupBy("event_type").agg(
        F.count_if(F.col("value") > 100).alias("above_100"), F.count_if(F.col("value") > 300).alias("above_300"))


@query("a28_annual_market_summary", """
    SELECT year_local AS year, count(*) AS hours, avg(p) AS mean, median(p) AS median, stddev_samp(p) AS std, min(p) AS min, max(p) AS max,
           avg(p) AS base, avg(p) FILTER (WHERE is_peak_hour) AS peak, avg(p) FILTER (WHERE NOT is_peak_hour) AS offpeak,
           avg(p) FILTER (WHERE is_peak_hour) - avg(p) FILTER (WHERE NOT is_peak_hour) AS peak_minus_offpeak,
           count(*) FILTER (WHERE p < 0) AS neg_hours, 100.0::DOUBLE * count(*) FILTER (WHERE p < 0) / count(*) AS neg_share_pct,
           coalesce(-avg(p) FILTER (WHERE p < 0), 0.0::DOUBLE) AS neg_mean_depth,
           coalesce(100.0::DOUBLE * count(*) FILTER (WHERE p < 0 AND month_local BETWEEN 4 AND 9 AND hour_local BETWEEN 10 AND 16)
                    / nullif(count(*) FILTER (WHERE p < 0), 0), 0.0::DOUBLE) AS neg_share_solar_pct,
           count(*) FILTER (WHERE p > 500) AS hours_above_500
    FROM (SELECT *, price_at_eur_mwh AS p FROM hourly WHERE price_at_eur_mwh IS NOT NULL) GROUP BY 1""",
    "mean median std min max base peak offpeak peak_minus_offpeak neg_share_pct neg_mean_depth neg_share_solar_pct")
def _(t: Feeds) -> DataFrame:
    return analytics.annual_market_summary(t.hourly)


@query("a29_spread_summary", """
    SELECT year_local AS year, count(*) AS hours, avg(s) AS mean, median(s) AS median, stddev_samp(s) AS std,
           100.0::DOUBLE * avg(CASE WHEN s > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_at_above_de_pct,
           avg(s) FILTER (WHERE is_peak_hour) AS mean_peak, avg(s) FILTER (WHERE NOT is_peak_hour) AS mean_offpeak
    FROM (SELECT *, spread_at_delu_eur_mwh AS s FROM hourly WHERE spread_at_delu_eur_mwh IS NOT NULL) GROUP BY 1""",
    "mean median std share_at_above_de_pct mean_peak mean_offpeak")
def _(t: Feeds) -> DataFrame:
    return analytics.spread_summary(t.hourly)


@query("a30_regime_statistics", """
    SELECT regime, count(*) AS days, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM labelled) AS occupancy_pct,
           avg(abs(d_t)) AS mean_abs_d_t, avg(price_base_eur_mwh) AS mean_price FROM labelled GROUP BY 1""",
    "occupancy_pct mean_abs_d_t mean_price")
def _(t: Feeds) -> DataFrame:
    return analytics.regime_stats(t.labelled)


@query("a31_annual_quality_summary", """
    SELECT year_local AS year, sum(expected_hours)::BIGINT AS expected_hours, sum(priced_hours_at)::BIGINT AS priced_hours_at,
           round(100.0::DOUBLE * sum(priced_hours_at) / sum(expected_hours), 2) AS coverage_at_pct,
           round(100.0::DOUBLE * sum(priced_hours_delu) / sum(expected_hours), 2) AS coverage_delu_pct,
           round(100.0::DOUBLE * sum(load_hours) / sum(expected_hours), 2) AS coverage_load_pct,
           round(100.0::DOUBLE * sum(weather_days) / sum(days_in_month), 2) AS coverage_weather_pct,
           sum(n_dst_days)::BIGINT AS dst_days, sum(n_hours_from_pt15m)::BIGINT AS hours_from_pt15m,
           sum(n_negative_hours)::BIGINT AS negative_hours, count(*) FILTER (WHERE has_oespi) AS oespi_months, count(*) AS months
    FROM dq GROUP BY 1""")
def _(t: Feeds) -> DataFrame:
    return analytics.annual_quality(t.dq)


@query("a32_monthly_profile_volumes", """
    SELECT profile, year_local, month_local, sum(load_mwh) AS volume_mwh FROM conload GROUP BY 1, 2, 3""", "volume_mwh:5")
def _(t: Feeds) -> DataFrame:
    return profile.monthly_volumes(profile.hourly_load(t.spine, [MAIN_PROFILE, FLAT_PROFILE]))


@query("a33_mart_coverage", """
    SELECT 'fct_price_monthly' AS mart_name, min(make_date(year_local, month_local, 1)) AS min_month,
           max(make_date(year_local, month_local, 1)) AS max_month, count(DISTINCT make_date(year_local, month_local, 1)) AS n_months FROM monthly
    UNION ALL SELECT 'fct_generation_monthly', min(make_date(year_local, month_local, 1)), max(make_date(year_local, month_local, 1)),
           count(DISTINCT make_date(year_local, month_local, 1)) FROM generation
    UNION ALL SELECT 'fct_procurement_cost_monthly', min(make_date(year_local, month_local, 1)), max(make_date(year_local, month_local, 1)),
           count(DISTINCT make_date(year_local, month_local, 1)) FROM costs""")
def _(t: Feeds) -> DataFrame:
    return analytics.mart_coverage({
        "fct_price_monthly": t.monthly, "fct_generation_monthly": t.generation, "fct_procurement_cost_monthly": t.costs})


@query("a34_complete_group_flag", """
    SELECT year(o_orderdate)::INT AS year, min(o_orderdate)::DATE = make_date(year(o_orderdate)::INT, 1, 1)
           AND max(o_orderdate)::DATE = make_date(year(o_orderdate)::INT, 12, 31) AS is_complete FROM orders GROUP BY year(o_orderdate)""")
def _(t: Feeds) -> DataFrame:
    year = F.col("year")
    g = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    full = (F.col("lo") == F.make_date(year, F.lit(1), F.lit(1))) & (F.col("hi") == F.make_date(year, F.lit(12), F.lit(31)))
    return g.select("year", full.alias("is_complete"))
