"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.functions import timecols as tc
from wattlake.functions.exprs import outside
from wattlake.operators.joins import with_bounds
from wattlake.plans import analytics
from wattlake.queries.feeds import Feeds
from wattlake.queries.registry import query


@query("p01_projection_rename", "SELECT o_orderkey AS order_id, o_totalprice AS price_eur FROM orders")
def _(t: Feeds) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("price_eur"))


@query("p02_type_pinning", """
    SELECT l_orderkey::INT AS order_id, l_quantity::BIGINT AS quantity, l_shipdate::DATE AS ship_date,
           l_linenumber::DOUBLE AS line, l_linestatus = 'O' AS is_open FROM lineitem""")
def _(t: Feeds) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").cast("int").alias("order_id"), F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_shipdate").cast("date").alias("ship_date"), F.col("l_linenumber").cast("double").alias("line"),
        (F.col("l_linestatus") == "O").alias("is_open"))


@query("p03_pushed_filters", """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_returnflag = 'R' AND l_quantity >= 45 AND l_discount IS NOT NULL AND l_shipdate < TIMESTAMP '1997-01-01'""")
def _(t: Feeds) -> DataFrame:
    # The stored column type is kept in the predicate, so the scan can use it.
    rows = t.table("lineitem")
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    keep = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45) & F.col("l_discount").isNotNull()
    return rows.where(keep & (F.col("l_shipdate") < cut)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("p04_three_valued_flag", """
    SELECT year_local, count(*) AS hours, count(*) FILTER (WHERE is_negative_price) AS negative,
           count(*) FILTER (WHERE NOT is_negative_price) AS not_negative, count(*) FILTER (WHERE is_negative_price IS NULL) AS unknown
    FROM hourly GROUP BY 1""")
def _(t: Feeds) -> DataFrame:
    flag = F.col("is_negative_price")
    return t.hourly.groupBy("year_local").agg(
        F.count("*").alias("hours"), F.count_if(flag).alias("negative"), F.count_if(~flag).alias("not_negative"),
        F.count_if(flag.isNull()).alias("unknown"))


@query("p05_spread_null_propagation", """
    SELECT ts_utc, price_at_eur_mwh - price_delu_eur_mwh AS spread FROM hourly WHERE load_at_mw IS NOT NULL""", "spread")
def _(t: Feeds) -> DataFrame:
    return t.hourly.where("load_at_mw is not null").select(
        "ts_utc", (F.col("price_at_eur_mwh") - F.col("price_delu_eur_mwh")).alias("spread"))


@query("p06_season_case", """
    SELECT CASE WHEN month(o_orderdate) IN (11, 12, 1, 2, 3) THEN 'winter' ELSE 'summer' END AS season,
           count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1""", "total:0")
def _(t: Feeds) -> DataFrame:
    season = tc.season(F.month("o_orderdate"))
    return t.orders.groupBy(season.alias("season")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("p07_resolution_classification", "SELECT resolution, count(*) AS months FROM dq GROUP BY 1")
def _(t: Feeds) -> DataFrame:
    return t.dq.groupBy("resolution").agg(F.count("*").alias("months"))


@query("p08_window_between_bounds", """
    SELECT c.year_local, c.month_local, count(*) AS hours FROM cal c, pricewindow
    WHERE make_date(c.year_local, c.month_local, 1) BETWEEN first_month AND last_month GROUP BY 1, 2""")
def _(t: Feeds) -> DataFrame:
    from wattlake.plans.marts import priced_window

    month = tc.month_of(F.col("year_local"), F.col("month_local"))
    inside = with_bounds(t.calendar, priced_window(t.hourly)).where(month.between(F.col("first_month"), F.col("last_month")))
    return inside.groupBy("year_local", "month_local").agg(F.count("*").alias("hours"))


@query("p09_month_range_filter", """
    SELECT date_local, hour_local, load_mwh FROM conload WHERE profile = 'main'
    AND make_date(year_local, month_local, 1) BETWEEN DATE '1999-11-01' AND DATE '2000-02-01'""", "load_mwh:8")
def _(t: Feeds) -> DataFrame:
    month = tc.month_of(F.col("year_local"), F.col("month_local"))
    keep = month.between(F.lit("1999-11-01").cast("date"), F.lit("2000-02-01").cast("date"))
    return t.main_load.where(keep).select("date_local", "hour_local", "load_mwh")


@query("p10_accepted_range", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
    WHERE (l_quantity < 5 OR l_quantity > 45) AND l_discount <= 0.0""")
def _(t: Feeds) -> DataFrame:
    broken = outside(F.col("l_quantity"), 5, 45) & outside(F.col("l_discount"), low=0.0, inclusive=False)
    return t.lineitem.where(broken).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("p11_substring_predicate", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'small')")
def _(t: Feeds) -> DataFrame:
    return t.table("part").where(F.contains(F.col("p_name"), F.lit("small"))).select("p_partkey", "p_name")


@query("p12_complete_years", """
    SELECT year_local, count(*) AS hours FROM hourly WHERE price_at_eur_mwh IS NOT NULL GROUP BY 1 HAVING count(*) >= 2000""")
def _(t: Feeds) -> DataFrame:
    # The test feed is sparse, hence a lower bar than a real year's 8,700 hours.
    return analytics.complete_years(t.hourly, 2000)
