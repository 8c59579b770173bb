"""Join shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.functions.exprs import sum_if
from wattlake.operators import checks
from wattlake.operators.joins import one_to_one, reconcile, with_bounds
from wattlake.operators.spine import month_spine
from wattlake.plans import gates, risk
from wattlake.queries.feeds import Feeds
from wattlake.queries.registry import query
from wattlake.sources.tables import strategy_dimension


@query("j01_spine_left_join", """
    SELECT c.ts_utc, p.zone, p.price_eur_mwh, l.load_mw FROM cal c
    LEFT JOIN prices p ON p.ts_utc = c.ts_utc LEFT JOIN sysload l ON l.ts_utc = c.ts_utc""",
    "price_eur_mwh load_mw")
def _(t: Feeds) -> DataFrame:
    price = t.prices.select("ts_utc", "zone", "price_eur_mwh")
    return t.calendar.select("ts_utc").join(price, "ts_utc", "left").join(t.load, "ts_utc", "left")


@query("j02_hour_to_day_fan_out", """
    SELECT c.ts_utc, c.date_local, w.tavg_c FROM cal c LEFT JOIN weather w ON w.date_local = c.date_local""", "tavg_c:1")
def _(t: Feeds) -> DataFrame:
    return t.calendar.select("ts_utc", "date_local").join(t.weather, "date_local", "left")


@query("j03_fact_calendar_inner_join", """
    SELECT p.zone, c.year_local, c.month_local, c.is_peak_hour, count(*) AS n, avg(p.price_eur_mwh) AS mean_price
    FROM prices p JOIN cal c ON c.ts_utc = p.ts_utc GROUP BY 1, 2, 3, 4""", "mean_price")
def _(t: Feeds) -> DataFrame:
    rows = t.prices.join(
        t.calendar.select("ts_utc", "year_local", "month_local", "is_peak_hour"), "ts_utc")
    return rows.groupBy("zone", "year_local", "month_local", "is_peak_hour").agg(
        F.count("*").alias("n"), F.avg("price_eur_mwh").alias("mean_price"))


@query("j04_three_way_inner_join", """
    SELECT l.profile, c.year_local, count(*) AS n, sum(l.load_mwh * h.price_at_eur_mwh) AS cost
    FROM conload l JOIN dimcal c ON c.ts_utc = l.ts_utc JOIN hourly h ON h.ts_utc = l.ts_utc
    WHERE h.price_at_eur_mwh IS NOT NULL GROUP BY 1, 2""", "cost:2")
def _(t: Feeds) -> DataFrame:
    price = t.hourly.where("price_at_eur_mwh is not null").select("ts_utc", "price_at_eur_mwh")
    load = t.consumer_load.select("profile", "ts_utc", "load_mwh")
    rows = load.join(t.calendar.select("ts_utc", "year_local"), "ts_utc").join(price, "ts_utc")
    return rows.groupBy("profile", "year_local").agg(
        F.count("*").alias("n"), F.sum(F.col("load_mwh") * F.col("price_at_eur_mwh")).alias("cost"))


@query("j05_composite_key_left_joins", """
    SELECT m.year_local, m.month_local, m.price_base_eur_mwh, s.spread_mean_eur_mwh, g.gwh, d.coverage_at_pct
    FROM monthly m LEFT JOIN spreadmonthly s ON s.year_local = m.year_local AND s.month_local = m.month_local
    LEFT JOIN (SELECT year_local, month_local, sum(gen_gwh) AS gwh FROM generation GROUP BY 1, 2) g
        ON g.year_local = m.year_local AND g.month_local = m.month_local
    LEFT JOIN dq d ON d.year_local = m.year_local AND d.month_local = m.month_local""",
    "price_base_eur_mwh spread_mean_eur_mwh gwh coverage_at_pct:3")
def _(t: Feeds) -> DataFrame:
    keys = ["year_local", "month_local"]
    total = t.generation.groupBy(*keys).agg(F.sum("gen_gwh").alias("gwh"))
    return (
        t.monthly.select(*keys, "price_base_eur_mwh")
        .join(t.spread.select(*keys, "spread_mean_eur_mwh"), keys, "left")
        .join(total, keys, "left").join(t.dq.select(*keys, "coverage_at_pct"), keys, "left"))


@query("j06_one_row_bounds", """
    SELECT o_orderkey, (o_orderdate::DATE - first_day)::INT AS day_no FROM orders
    CROSS JOIN (SELECT min(o_orderdate)::DATE AS first_day FROM orders)""")
def _(t: Feeds) -> DataFrame:
    first = t.orders.agg(F.to_date(F.min("o_orderdate")).alias("first_day"))
    return with_bounds(t.orders, first).select(
        "o_orderkey", F.datediff("o_orderdate", "first_day").alias("day_no"))


@query("j07_dimension_label_join", """
    SELECT c.strategy_id, d.strategy_name, sum(c.cost_eur) AS cost_eur
    FROM costs c JOIN dimstrategy d ON d.strategy_id = c.strategy_id GROUP BY 1, 2""", "cost_eur:2")
def _(t: Feeds) -> DataFrame:
    labelled = t.costs.join(F.broadcast(strategy_dimension(t.spark)), "strategy_id")
    return labelled.groupBy("strategy_id", "strategy_name").agg(F.sum("cost_eur").alias("cost_eur"))


@query("j07_nation_region_labels", """
    SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def _(t: Feeds) -> DataFrame:
    # Count per key first: the labels then join 25 rows, not every customer.
    counts = t.table("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    nation = t.table("nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return counts.join(nation, "n_nationkey").join(t.table("region"), "r_regionkey").select("r_name", "n_name", "customers")


@query("j08_gap_anti_join", """
    SELECT d AS date_local FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY))::DATE AS d FROM orders)
    LEFT JOIN (SELECT DISTINCT o_orderdate::DATE AS od FROM orders) ON od = d WHERE od IS NULL""")
def _(t: Feeds) -> DataFrame:
    from wattlake.operators.spine import day_spine

    days = t.orders.select(F.to_date("o_orderdate").alias("date_local"))
    bounds = days.agg(F.min("date_local").alias("first_day"), F.max("date_local").alias("last_day"))
    return day_spine(bounds).join(days.distinct(), "date_local", "left_anti")


@query("j09_semi_join", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def _(t: Feeds) -> DataFrame:
    debtors = t.table("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(debtors, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("j10_referential_integrity", """
    SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (
        SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)""")
def _(t: Feeds) -> DataFrame:
    active = t.table("customer").where("c_acctbal >= 0")
    return checks.orphans(t.orders, active, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("j11_scalar_bound_comparison", """
    SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate > (SELECT max(o_orderdate) FROM orders)
        OR l_shipdate < (SELECT min(o_orderdate) FROM orders)""")
def _(t: Feeds) -> DataFrame:
    bounds = t.orders.agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    ship = F.col("l_shipdate")
    outside = (ship < F.col("lo")) | (ship > F.col("hi"))
    return with_bounds(t.lineitem, bounds).where(outside).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("j12_transcription_reconcile", """
    SELECT coalesce(a.k, b.k) AS o_orderkey, a.v AS price_1, b.v AS price_2,
           CASE WHEN b.k IS NULL THEN 'only_first' WHEN a.k IS NULL THEN 'only_second' ELSE 'value_mismatch' END AS status
    FROM (SELECT o_orderkey AS k, trim(' ' || (o_totalprice::INT)::VARCHAR) AS v FROM orders WHERE o_orderkey % 11 <> 0) a
    FULL JOIN (SELECT o_orderkey AS k, trim(((o_totalprice + (CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END))::INT)::VARCHAR || ' ') AS v
               FROM orders WHERE o_orderkey % 13 <> 0) b ON a.k = b.k
    WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""")
def _(t: Feeds) -> DataFrame:
    """Two keyed entries of the same table: each misses some keys, one has typing errors."""
    price = F.col("o_totalprice")
    slip = F.when(F.col("o_custkey") % 5 == 0, 1).otherwise(0)
    first = t.orders.where("o_orderkey % 11 <> 0").select(
        "o_orderkey", F.concat(F.lit(" "), F.rint(price).cast("int").cast("string")).alias("price"))
    second = t.orders.where("o_orderkey % 13 <> 0").select(
        "o_orderkey", F.concat(F.rint(price + slip).cast("int").cast("string"), F.lit(" ")).alias("price"))
    return reconcile(first, second, ["o_orderkey"], ["price"])


@query("j13_match_coverage", """
    SELECT p.zone, year((p.ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Vienna')::INT AS year_local, count(*) AS price_hours,
           count(l.ts_utc) AS matched_hours
    FROM prices p LEFT JOIN sysload l ON l.ts_utc = p.ts_utc GROUP BY 1, 2""")
def _(t: Feeds) -> DataFrame:
    rows = gates.join_coverage(t.prices, t.load)
    return rows.select("zone", F.col("year").alias("year_local"), "price_hours", "matched_hours")


@query("j14_one_to_one_merge", """
    SELECT s.profile, s.year_local, s.month_local, s.volume_mwh, o.oespi_base FROM spot s
    LEFT JOIN obs o ON o.year_local = s.year_local AND o.month_local = s.month_local""",
    "volume_mwh:5 oespi_base")
def _(t: Feeds) -> DataFrame:
    months = t.spot.select("profile", "year_local", "month_local", "volume_mwh")
    index = t.observed_index.select("year_local", "month_local", "oespi_base")
    return one_to_one(months, index, ["year_local", "month_local"], within=["profile"])


@query("j15_rows_not_delivered_before", """
    SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' EXCEPT
    SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R'""")
def _(t: Feeds) -> DataFrame:
    cols = ["l_orderkey", "l_linenumber"]
    new = t.lineitem.where("l_returnflag = 'R'").select(*cols).distinct()
    return new.join(t.lineitem.where("l_returnflag <> 'R'").select(*cols), cols, "left_anti")


@query("j16_observed_drawn_carried", "SELECT * FROM locksource", "obs_base obs_peak last_base last_peak")
def _(t: Feeds) -> DataFrame:
    return risk.lock_slots(t.observed_index, t.targets, t.cfg.lock_months)


@query("j17_hour_alignment", "SELECT * FROM aligned", "load_mwh:8 price")
def _(t: Feeds) -> DataFrame:
    years = t.pool.select("month_local", "pool_year").distinct()
    return risk.align_hours(t.main_load, t.hourly, t.targets, years)


@query("j18_year_price_map", """
    SELECT p.profile, l.scenario, p.year_local, p.month_local, p.volume_mwh * l.lock_price AS cost_eur FROM spot p
    JOIN locks l ON l.year_local = p.year_local AND l.profile = p.profile""", "cost_eur:2")
def _(t: Feeds) -> DataFrame:
    from wattlake.plans import strategies

    lock = strategies.lock_prices(t.observed_index, t.scenarios, t.cfg.years)
    return t.spot.join(lock, ["profile", "year_local"]).select(
        "profile", "scenario", "year_local", "month_local", (F.col("volume_mwh") * F.col("lock_price")).alias("cost_eur"))


@query("j19_scenario_grid", """
    SELECT scenario, count(*) AS n, sum(cost_eur) FILTER (WHERE strategy_id = 'S3') AS s3_cost FROM scencosts GROUP BY 1""", "s3_cost:2")
def _(t: Feeds) -> DataFrame:
    return t.scenario_costs.groupBy("scenario").agg(
        F.count("*").alias("n"), sum_if(F.col("strategy_id") == "S3", F.col("cost_eur")).alias("s3_cost"))


@query("j20_star_schema", """
    SELECT d.year_local, s.strategy_name, sum(c.cost_eur) AS cost_eur, sum(c.volume_mwh) AS volume_mwh
    FROM costs c JOIN dimstrategy s ON s.strategy_id = c.strategy_id
    JOIN (SELECT DISTINCT year_local, month_local FROM cal) d ON d.year_local = c.year_local AND d.month_local = c.month_local
    GROUP BY 1, 2""", "cost_eur:2 volume_mwh:4")
def _(t: Feeds) -> DataFrame:
    months = month_spine(t.bounds, "m").select(F.year("m").alias("year_local"), F.month("m").alias("month_local"))
    # Both dimensions are bounded: six strategies, one row per calendar month.
    rows = t.costs.join(F.broadcast(strategy_dimension(t.spark)), "strategy_id").join(
        F.broadcast(months), ["year_local", "month_local"])
    return rows.groupBy("year_local", "strategy_name").agg(
        F.sum("cost_eur").alias("cost_eur"), F.sum("volume_mwh").alias("volume_mwh"))
