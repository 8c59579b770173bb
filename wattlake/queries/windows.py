"""Window operators, ordering and set operations."""

from __future__ import annotations

from functools import reduce
from itertools import product
from string import Formatter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.config import MAIN_PROFILE, STRATEGY_DIM
from wattlake.operators import blocks, quantiles, series, stats
from wattlake.operators.dedup import duplicate_surplus
from wattlake.operators.joins import fill_in_order
from wattlake.operators.spine import holiday_dimension, month_spine
from wattlake.plans import analytics, risk, strategies
from wattlake.queries.feeds import Feeds
from wattlake.queries.registry import query
from wattlake.sources.tables import strategy_dimension


@query("w02_share_of_partition_total", """
    SELECT d AS day, event_type, n, n::DOUBLE / sum(n) OVER (PARTITION BY d) AS share
    FROM (SELECT ts::DATE AS d, event_type, count(*) AS n FROM events GROUP BY 1, 2)""", "share:8")
def _(t: Feeds) -> DataFrame:
    counts = t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", series.share_of_group(F.col("n"), ["day"]))


ANNUAL_PRIORITY = """
    SELECT year(o_orderdate)::INT AS year, o_orderpriority AS strategy_id, sum(o_totalprice) AS cost FROM orders GROUP BY 1, 2"""


def annual_priority(t: Feeds) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("strategy_id")).agg(
        F.sum("o_totalprice").alias("cost"))


@query("w03_delta_to_group_minimum", f"""
    SELECT year, strategy_id, cost - min(cost) OVER (PARTITION BY year) AS delta FROM ({ANNUAL_PRIORITY})""", "delta:2")
def _(t: Feeds) -> DataFrame:
    return annual_priority(t).select("year", "strategy_id", series.above_group_min(F.col("cost"), ["year"]).alias("delta"))


@query("w04_rank", f"""
    SELECT year, strategy_id, (rank() OVER (PARTITION BY year ORDER BY cost))::INT AS rank FROM ({ANNUAL_PRIORITY})""")
def _(t: Feeds) -> DataFrame:
    return annual_priority(t).select("year", "strategy_id", series.rank_in_group(F.col("cost"), ["year"]).alias("rank"))


@query("w05_grand_total_per_row", f"""
    SELECT year, gap, sum(gap) OVER () AS total FROM (SELECT year, max(cost) - min(cost) AS gap FROM ({ANNUAL_PRIORITY}) GROUP BY 1)""", "gap:2 total:2")
def _(t: Feeds) -> DataFrame:
    gaps = annual_priority(t).groupBy("year").agg((F.max("cost") - F.min("cost")).alias("gap"))
    return gaps.withColumn("total", gaps.agg(F.sum("gap")).scalar())


@query("w06_tail_mean", """
    SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) FILTER (WHERE rn <= ceil(0.05 * n)) AS cvar95
    FROM (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS rn,
                 count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY 1""", "cvar95:4")
def _(t: Feeds) -> DataFrame:
    out = quantiles.describe_groups(t.lineitem, ["l_returnflag"], "l_extendedprice", tail_share=0.05, tail_name="cvar95")
    return out.select("l_returnflag", "n", "cvar95")


@query("w07_first_difference", "SELECT date_local, price_base_eur_mwh, d_t FROM diffs", "price_base_eur_mwh d_t")
def _(t: Feeds) -> DataFrame:
    daily = t.daily.where("price_base_eur_mwh is not null").select("date_local", "price_base_eur_mwh")
    moved = blocks.from_previous(daily, [], "date_local", "price_base_eur_mwh", "before", blocks.day_block("date_local"))
    return moved.select("date_local", "price_base_eur_mwh", (F.col("price_base_eur_mwh") - F.col("before")).alias("d_t")).where("d_t is not null")


@query("w07_difference_per_series", """
    SELECT p AS series, d AS day, v - lag(v) OVER (PARTITION BY p ORDER BY d) AS d_t FROM (
        SELECT o_orderpriority AS p, o_orderdate::DATE AS d, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)""", "d_t:3")
def _(t: Feeds) -> DataFrame:
    daily = t.orders.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(
        F.avg("o_totalprice").alias("v"))
    return series.difference(daily, ["series"], "day", "v").select("series", "day", "d_t")


@query("w08_rolling_deviation", "SELECT date_local, realized_vol FROM diffs", "realized_vol")
def _(t: Feeds) -> DataFrame:
    return analytics.daily_differences(t.daily).select("date_local", "realized_vol")


@query("w09_running_total", """
    SELECT strategy_id, year_local, month_local, sum(cost_eur) OVER (PARTITION BY strategy_id ORDER BY year_local, month_local) AS cumulative_eur
    FROM costs""", "cumulative_eur:2")
def _(t: Feeds) -> DataFrame:
    return analytics.cumulative_cost(t.costs).select("strategy_id", "year_local", "month_local", "cumulative_eur")


@query("w10_forward_back_fill", """
    SELECT ts_utc, coalesce(last_value(load_at_mw IGNORE NULLS) OVER (PARTITION BY year_local, month_local ORDER BY ts_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    first_value(load_at_mw IGNORE NULLS) OVER (PARTITION BY year_local, month_local ORDER BY ts_utc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS load_at_mw
    FROM hourly""", "load_at_mw")
def _(t: Feeds) -> DataFrame:
    rows = t.hourly.select("ts_utc", "year_local", "month_local", "load_at_mw")
    return fill_in_order(rows, ["year_local", "month_local"], "ts_utc", "load_at_mw").select("ts_utc", "load_at_mw")


def index_series(t: Feeds) -> DataFrame:
    """The monthly index as a series by name."""
    return t.index.select(F.lit("oespi").alias("index_name"), "month_local", "oespi_base")


@query("w11_relative_monthly_change", """
    SELECT month_local, oespi_base / lag(oespi_base) OVER (ORDER BY month_local) - 1.0::DOUBLE AS mom FROM idx""", "mom:8")
def _(t: Feeds) -> DataFrame:
    told = blocks.from_previous(index_series(t), ["index_name"], "month_local", "oespi_base", "before", blocks.day_block("month_local"))
    return told.select("month_local", (F.try_divide("oespi_base", "before") - 1.0).alias("mom"))


@query("w12_index_to_first", """
    SELECT month_local, 100.0::DOUBLE * oespi_base / first_value(oespi_base) OVER (ORDER BY month_local) AS base100 FROM idx""", "base100")
def _(t: Feeds) -> DataFrame:
    return blocks.index_to_first(index_series(t), ["index_name"], "month_local", "oespi_base", "base100").select("month_local", "base100")


@query("w13_share_of_sum_normalisation", """
    SELECT y AS year, d AS day, 50000.0::DOUBLE * q / sum(q) OVER (PARTITION BY y) AS mwh
    FROM (SELECT year(l_shipdate)::INT AS y, l_shipdate::DATE AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)""", "mwh")
def _(t: Feeds) -> DataFrame:
    daily = t.lineitem.groupBy(F.year("l_shipdate").alias("year"), F.to_date("l_shipdate").alias("day")).agg(
        F.sum("l_quantity").alias("q"))
    return daily.select("year", "day", (F.lit(50000.0) * series.share_of_group(F.col("q"), ["year"])).alias("mwh"))


@query("w14_runner_up_margin", f"""
    SELECT year, max(CASE WHEN rn = 1 THEN strategy_id END) AS best, max(CASE WHEN rn = 2 THEN strategy_id END) AS runner_up,
           max(CASE WHEN rn = 2 THEN cost END) - max(CASE WHEN rn = 1 THEN cost END) AS margin
    FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY cost, strategy_id) AS rn FROM ({ANNUAL_PRIORITY})) GROUP BY 1""", "margin:2")
def _(t: Feeds) -> DataFrame:
    return series.runner_up(annual_priority(t), ["year"], "strategy_id", "cost")


@query("w15_duration_curve", """
    SELECT year_local, price_at_eur_mwh, (row_number() OVER w)::INT AS rank,
           CASE WHEN count(*) OVER (PARTITION BY year_local) > 1 THEN
                100.0::DOUBLE * (row_number() OVER w - 1) / (count(*) OVER (PARTITION BY year_local) - 1) ELSE 0.0::DOUBLE END AS share_pct
    FROM hourly WHERE price_at_eur_mwh IS NOT NULL WINDOW w AS (PARTITION BY year_local ORDER BY price_at_eur_mwh DESC)""",
    "price_at_eur_mwh share_pct")
def _(t: Feeds) -> DataFrame:
    return series.duration_curve(analytics.priced_hours(t.hourly), ["year_local"], "price_at_eur_mwh")


@query("w16_gap_to_previous", """
    SELECT event_id, epoch_us(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) / 60000000.0::DOUBLE AS gap_minutes FROM events""", "gap_minutes:9")
def _(t: Feeds) -> DataFrame:
    return series.gap_minutes(t.events.select("event_id", "event_type", "ts"), ["event_type"], "ts").select("event_id", "gap_minutes")


@query("w17_duplicate_surplus", """
    SELECT zone, m AS month, sum(n - 1)::BIGINT AS n_duplicates FROM (
        SELECT zone, date_trunc('month', ts_utc)::DATE AS m, ts_utc, count(*) AS n FROM raw_prices GROUP BY 1, 2, 3 HAVING count(*) > 1)
    GROUP BY 1, 2""")
def _(t: Feeds) -> DataFrame:
    rows = t.raw_prices.select("zone", "ts_utc", F.to_date(F.trunc("ts_utc", "MM")).alias("month"))
    return duplicate_surplus(rows, ["zone", "ts_utc"], ["zone", "month"])


# ---- order and top-k -----------------------------------------------------------
@query("o01_multi_key_order", f"SELECT * FROM ({ANNUAL_PRIORITY}) ORDER BY year, strategy_id", "cost:2")
def _(t: Feeds) -> DataFrame:
    return annual_priority(t).orderBy("year", "strategy_id")


@query("o02_last_priced_month", "SELECT last_month FROM lastmonth")
def _(t: Feeds) -> DataFrame:
    return risk.last_priced_month(t.monthly)


@query("o03_custom_order", """
    SELECT c.strategy_id, d.sort_order, count(*) AS n FROM costs c JOIN dimstrategy d ON d.strategy_id = c.strategy_id
    GROUP BY 1, 2 ORDER BY sort_order""")
def _(t: Feeds) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(s) for s in t.cfg.strategy_ids]), F.col("strategy_id")).cast("int")
    dim = strategy_dimension(t.spark).withColumn("sort_order", order)
    counts = t.costs.groupBy("strategy_id").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(dim), "strategy_id").select("strategy_id", "sort_order", "n").orderBy("sort_order")


@query("o04_top_one_with_tie_break", """
    SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 100000), o_orderkey) = 1""")
def _(t: Feeds) -> DataFrame:
    bucket = F.floor(F.col("o_totalprice") / 100000 + 0.5)
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(bucket, F.col("o_orderkey"))).alias("o_orderkey"))


@query("o05_yearly_winners", f"""
    SELECT year, strategy_id AS winner FROM ({ANNUAL_PRIORITY}) QUALIFY row_number() OVER (PARTITION BY year ORDER BY cost, strategy_id) = 1""")
def _(t: Feeds) -> DataFrame:
    return annual_priority(t).groupBy("year").agg(F.min_by("strategy_id", F.struct("cost", "strategy_id")).alias("winner"))


# ---- set operations --------------------------------------------------------------
@query("u01_union_all", """
    SELECT o_orderdate::DATE AS day, 'order' AS kind FROM orders UNION ALL SELECT l_shipdate::DATE, 'ship' FROM lineitem""")
def _(t: Feeds) -> DataFrame:
    a = t.orders.select(F.to_date("o_orderdate").alias("day"), F.lit("order").alias("kind"))
    return a.unionByName(t.lineitem.select(F.to_date("l_shipdate").alias("day"), F.lit("ship").alias("kind")))


@query("u02_union_distinct_with_values", """
    SELECT o_orderdate::DATE AS day FROM orders UNION
    SELECT * FROM (VALUES (DATE '1996-03-31'), (DATE '1996-10-27')) v(day)""")
def _(t: Feeds) -> DataFrame:
    fixed = t.spark.createDataFrame([("1996-03-31",), ("1996-10-27",)], "d string").select(F.to_date("d").alias("day"))
    days = t.orders.select(F.to_date("o_orderdate").alias("day"))
    return days.union(fixed).distinct()


@query("u03_distinct", "SELECT DISTINCT year(l_shipdate)::INT AS y, month(l_shipdate)::INT AS m, l_returnflag FROM lineitem")
def _(t: Feeds) -> DataFrame:
    return t.lineitem.select(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"), "l_returnflag").distinct()


@query("u04_set_difference", """
    SELECT p AS o_orderpriority, d AS day FROM (SELECT DISTINCT o_orderpriority AS p FROM orders),
        (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY))::DATE AS d FROM orders)
    EXCEPT SELECT o_orderpriority, o_orderdate::DATE FROM orders""")
def _(t: Feeds) -> DataFrame:
    from wattlake.operators.spine import day_spine

    bounds = t.orders.agg(F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))
    seen = t.orders.select("o_orderpriority", F.to_date("o_orderdate").alias("day"))
    # The calendar is one array of days on every priority's row.
    days = day_spine(bounds).agg(F.collect_list("date_local")).scalar()
    expected = seen.select("o_orderpriority").distinct().select("o_orderpriority", F.explode(days).alias("day"))
    return expected.subtract(seen)


@query("u05_intersection", """
    SELECT ts_utc FROM prices WHERE zone = 'AT' INTERSECT SELECT ts_utc FROM sysload""")
def _(t: Feeds) -> DataFrame:
    return t.prices.where("zone = 'AT'").select("ts_utc").intersect(t.load.select("ts_utc"))


@query("u05_holiday_set_equality", """
    SELECT y::INT AS year, count(*) AS n_expected, 0::BIGINT AS n_missing FROM hol
    JOIN (SELECT DISTINCT year_local FROM cal) ON year_local = y GROUP BY 1""")
def _(t: Feeds) -> DataFrame:
    expected = holiday_dimension(t.calendar.select(F.col("year_local").alias("year")).distinct())
    flagged = t.calendar.where("is_holiday_at").select("date_local").distinct().withColumn("seen", F.lit(True))
    both = expected.join(flagged, "date_local", "left")
    return both.groupBy("year").agg(
        F.count("*").alias("n_expected"), F.count_if(F.col("seen").isNull() & (F.col("date_local") <= t.bounds.select("last_day").scalar())).alias("n_missing"))


@query("u06_unpivot", """
    SELECT o_orderkey, kv.k AS measure, kv.v AS value FROM (
        SELECT o_orderkey, unnest([{'k': 'price', 'v': o_totalprice}, {'k': 'half', 'v': o_totalprice / 2}]) AS kv FROM orders)""")
def _(t: Feeds) -> DataFrame:
    wide = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_totalprice") / 2).alias("half"))
    return wide.unpivot("o_orderkey", ["price", "half"], "measure", "value")


@query("u07_month_spine", """
    SELECT unnest(generate_series(date_trunc('month', min(l_shipdate)), date_trunc('month', max(l_shipdate)), INTERVAL 1 MONTH))::DATE AS month_start
    FROM lineitem""")
def _(t: Feeds) -> DataFrame:
    bounds = t.lineitem.agg(F.to_date(F.min("l_shipdate")).alias("first_day"), F.to_date(F.max("l_shipdate")).alias("last_day"))
    return month_spine(bounds)


NUMBERS = "SELECT * FROM published"


def numbers(t: Feeds) -> DataFrame:
    """``published_numbers``, written once per session."""
    return t.kept("numbers", published_numbers)


def published_numbers(t: Feeds) -> DataFrame:
    """The published numbers of all producers in one table; year-keyed market figures for complete years only."""
    annual, base = strategies.annual_summary(t.costs), t.base_params
    wrong = strategies.wrong_strategy_cost(annual)
    total = annual.groupBy("strategy_id").agg(F.sum("cost_eur").alias("c"))
    best = total.agg(F.min_by("strategy_id", F.struct("c", "strategy_id")).alias("v"))
    years = t.complete_years
    hours = analytics.priced_hours(t.hourly).join(years, "year_local", "left_semi")
    suffix = F.when(F.col("variant") == "unconditional", "").otherwise("_nocrisis")
    metrics = t.risk_summary.select(
        "strategy_id", suffix.alias("suffix"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in ("mean", "p5", "p50", "p95", "cvar95")])),
    )
    moves = t.differences.withColumn("zone", F.lit("AT"))
    garch = stats.garch_grid(moves, ["zone"], "date_local", "d_t", stats.GARCH_ALPHAS, stats.GARCH_BETAS)
    profile = F.when(F.col("profile") == MAIN_PROFILE.name, "").otherwise(F.concat(F.lit("_"), "profile"))
    key = lambda *parts: F.concat(*[F.lit(p) if p.endswith("_") else F.col(p).cast("string") for p in parts])
    two, four = (lambda c: F.format_string("%.2f", c)), (lambda c: F.format_string("%.4f", c))
    retrospective = [
        (wrong, key("wrong_strategy_cost_", "year"), two("wrong_strategy_cost_eur"), "EUR"),
        (wrong.agg(F.sum("wrong_strategy_cost_eur").alias("v")), F.lit("wrong_strategy_cost_total"), two("v"), "EUR"),
        (annual, F.concat(key("cost_", "strategy_id"), F.lit("_"), key("year")), two("cost_eur"), "EUR"),
        (annual, F.concat(key("unit_cost_", "strategy_id"), F.lit("_"), key("year")), four("unit_cost_eur_mwh"), "EUR/MWh"),
        (total, key("cost5yr_", "strategy_id"), two("c"), "EUR"),
        (best, F.lit("best_strategy_5yr"), F.col("v"), "strategy_id"),
        *[(base, F.lit(c), four(c), unit) for c, unit in (
            ("p_ref_base", "EUR/MWh"), ("p_ref_peak", "EUR/MWh"), ("oespi_base_ref", "index"), ("oespi_peak_ref", "index"))],
    ]
    negative = t.monthly.join(years, "year_local", "left_semi").groupBy("year_local").agg(F.sum("n_negative_hours").alias("v"))
    descriptive = [
        (hours.groupBy("year_local").agg(F.avg("price_at_eur_mwh").alias("v")), key("annual_mean_price_", "year_local"), two("v"), "EUR/MWh"),
        (negative, key("neg_hours_", "year_local"), F.col("v").cast("string"), "hours"),
        (risk.last_priced_month(t.monthly), F.lit("data_last_month"), F.date_format("last_month", "yyyy-MM"), "month"),
    ]
    spread = t.hourly.where("spread_at_delu_eur_mwh is not null").join(years, "year_local", "left_semi").groupBy("year_local").agg(
        F.avg("spread_at_delu_eur_mwh").alias("v"))
    families = [
        ("CALIBRATED", "strategies/retrospective", retrospective),
        ("CALIBRATED", "consumer/profile", [(t.peak_share, F.concat(F.lit("consumer_peak_share"), profile), four("peak_share"), "share")]),
        ("SIMULATED", "strategies/forward_risk",
         [(metrics, F.concat("m", F.lit("_next12m"), "suffix", F.lit("_"), "strategy_id"), two("v"), "EUR")]),
        ("VERIFIED", "analytics/descriptive", descriptive),
        ("VERIFIED", "analytics/spread", [(spread, key("spread_mean_", "year_local"), two("v"), "EUR/MWh")]),
        ("VERIFIED", "analytics/volatility", [(garch, F.lit("garch_persistence"), four("persistence"), "ratio")]),
    ]
    parts = [
        df.select(k.alias("key"), v.alias("value"), F.lit(unit).alias("unit"), F.lit(tag).alias("tag"), F.lit(producer).alias("produced_by"))
        for tag, producer, rows in families
        for df, k, v, unit in rows
    ]
    return reduce(DataFrame.unionByName, parts)


#: Names of the numbers that every publication has, with what each is published by.
REQUIRED_NUMBERS = (
    "annual_mean_price_{year}", "best_strategy_5yr", "consumer_peak_share", "cost_{strategy}_{year}", "cvar95_next12m_{strategy}",
    "data_last_month", "garch_persistence", "neg_hours_{year}", "oespi_base_ref", "p95_next12m_{strategy}", "p_ref_base", "p_ref_peak",
    "spread_mean_{year}", "wrong_strategy_cost_total", "wrong_strategy_cost_{year}",
)


def required_numbers(t: Feeds) -> list[str]:
    """Keys every publication must have: each name for all years and strategies of the configuration that it asks for."""
    by = {"year": t.cfg.years, "strategy": [row[0] for row in STRATEGY_DIM]}
    keys: list[str] = []
    for name in REQUIRED_NUMBERS:
        asked = [part for _, part, _, _ in Formatter().parse(name) if part]
        keys += [name.format(**dict(zip(asked, values, strict=True))) for values in product(*[by[part] for part in asked])]
    return keys


@query("u08_numbers_table", NUMBERS)
def _(t: Feeds) -> DataFrame:
    from wattlake.sources.sinks import numbers_table

    return numbers_table(numbers(t))
