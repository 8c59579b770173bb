"""Time-series and statistical operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.operators import stats
from wattlake.plans import analytics
from wattlake.queries.feeds import Feeds
from wattlake.queries.oracle import garch_sql, regimes_sql
from wattlake.queries.registry import query


def zone_daily(t: Feeds) -> DataFrame:
    """Daily base price per zone: several series at once."""
    return t.prices.groupBy("zone", F.to_date("ts_utc").alias("date_local")).agg(
        F.avg("price_eur_mwh").alias("price_base_eur_mwh"))


ZONE_DAILY = "SELECT zone, ts_utc::DATE AS date_local, avg(price_eur_mwh) AS p FROM prices GROUP BY 1, 2"


@query("t01_differences_and_realised_volatility", f"""
    SELECT * FROM (SELECT zone, date_local, d_t, CASE WHEN count(d_t) OVER r = 30 THEN stddev_samp(d_t) OVER r END AS realized_vol
        FROM (SELECT *, p - lag(p) OVER (PARTITION BY zone ORDER BY date_local) AS d_t FROM ({ZONE_DAILY}))
        WINDOW r AS (PARTITION BY zone ORDER BY date_local ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE d_t IS NOT NULL""",
    "d_t realized_vol")
def _(t: Feeds) -> DataFrame:
    return analytics.daily_differences(zone_daily(t), ["zone"]).select("zone", "date_local", "d_t", "realized_vol")


@query("t02_z_score", """
    SELECT event_id, (value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type) AS z FROM events""", "z:7")
def _(t: Feeds) -> DataFrame:
    return stats.z_score(t.events, ["event_type"], "value").select("event_id", "z")


@query("t03_volatility_regimes", f"""
    SELECT zone, regime, count(*) AS days, avg(abs(d_t)) AS mean_abs_d_t FROM ({regimes_sql(
        f"SELECT zone, date_local, p - lag(p) OVER (PARTITION BY zone ORDER BY date_local) AS d_t FROM ({ZONE_DAILY})", "zone")})
    GROUP BY 1, 2""", "mean_abs_d_t:5")
def _(t: Feeds) -> DataFrame:
    """Occupancy per zone and regime."""
    moves = analytics.daily_differences(zone_daily(t), ["zone"])
    labelled = stats.volatility_regimes(moves, ["zone"], "d_t")
    return labelled.groupBy("zone", "regime").agg(
        F.count("*").alias("days"), F.avg(F.abs("d_t")).alias("mean_abs_d_t"))


@query("t04_garch_grid", f"""{garch_sql(f'SELECT zone, date_local, p - lag(p) OVER (PARTITION BY zone ORDER BY date_local) AS d_t FROM ({ZONE_DAILY})')}""",
    "alpha beta omega:4 log_likelihood:3 next_vol:4 persistence")
def _(t: Feeds) -> DataFrame:
    moves = analytics.daily_differences(zone_daily(t), ["zone"])
    return stats.garch_grid(moves, ["zone"], "date_local", "d_t", stats.GARCH_ALPHAS, stats.GARCH_BETAS)


DAILY_LOAD = """
    SELECT l.date_local, load_mean_mw AS y, hdd_18 AS x, is_free::INT::DOUBLE AS w, month_local AS m, is_free, hdd_18, load_mean_mw, month_local FROM (
        SELECT date_local, avg(load_at_mw) AS load_mean_mw, bool_or(is_weekend OR is_holiday_at) AS is_free, min(month_local) AS month_local
        FROM hourly WHERE load_at_mw IS NOT NULL GROUP BY 1) l JOIN (SELECT date_local, hdd_18 FROM daily WHERE hdd_18 IS NOT NULL) d ON d.date_local = l.date_local"""


@query("t05_ols_month_effects_hc1", f"""
    WITH d AS (SELECT * FROM ({DAILY_LOAD})),
    c AS (SELECT y, y - avg(y) OVER (PARTITION BY m) AS ry, x - avg(x) OVER (PARTITION BY m) AS rx, w - avg(w) OVER (PARTITION BY m) AS rw FROM d),
    k AS (SELECT sum(rx * rx) AS xx, sum(rx * rw) AS xw, sum(rw * rw) AS ww, sum(rx * ry) AS xy, sum(rw * ry) AS wy, count(*) AS n, var_pop(y) * count(*) AS sst FROM c),
    b AS (SELECT *, xx * ww - xw * xw AS det, (ww * xy - xw * wy) / (xx * ww - xw * xw) AS bx, (xx * wy - xw * xy) / (xx * ww - xw * xw) AS bw FROM k),
    e AS (SELECT c.*, ry - bx * rx - bw * rw AS e FROM c, b),
    q AS (SELECT sum(e * e) AS ssr, sum(e * e * rx * rx) AS mxx, sum(e * e * rx * rw) AS mxw, sum(e * e * rw * rw) AS mww FROM e),
    s AS (SELECT b.*, q.*, (SELECT count(DISTINCT m) FROM d) + 2 AS p,
                 sqrt((ww * ww * mxx - 2 * ww * xw * mxw + xw * xw * mww) / (det * det) * n / (n - ((SELECT count(DISTINCT m) FROM d) + 2))) AS sx,
                 sqrt((xw * xw * mxx - 2 * xx * xw * mxw + xx * xx * mww) / (det * det) * n / (n - ((SELECT count(DISTINCT m) FROM d) + 2))) AS sw FROM b, q)
    SELECT 'hdd_18' AS term, bx AS estimate, sx AS std_error, bx - 1.959963984540054 * sx AS ci_low, bx + 1.959963984540054 * sx AS ci_high, n AS n_obs, 1 - ssr / sst AS r_squared FROM s
    UNION ALL SELECT 'weekend', bw, sw, bw - 1.959963984540054 * sw, bw + 1.959963984540054 * sw, n, 1 - ssr / sst FROM s""",
    "estimate:5 std_error:5 ci_low:5 ci_high:5 r_squared:8")
def _(t: Feeds) -> DataFrame:
    rows = analytics.daily_load(t.hourly, t.daily).withColumn("weekend", F.col("is_weekend_or_holiday").cast("double"))
    return stats.ols_fixed_effects(rows, "load_mean_mw", ["hdd_18", "weekend"], "month_local")


@query("t05_ols_on_raw_rows", """
    WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x, l_discount AS w, l_linenumber AS m FROM lineitem),
    c AS (SELECT y, y - avg(y) OVER (PARTITION BY m) AS ry, x - avg(x) OVER (PARTITION BY m) AS rx, w - avg(w) OVER (PARTITION BY m) AS rw FROM d),
    k AS (SELECT sum(rx * rx) AS xx, sum(rx * rw) AS xw, sum(rw * rw) AS ww, sum(rx * ry) AS xy, sum(rw * ry) AS wy, count(*) AS n FROM c)
    SELECT 'l_quantity' AS term, (ww * xy - xw * wy) / (xx * ww - xw * xw) AS estimate, n AS n_obs FROM k
    UNION ALL SELECT 'l_discount', (xx * wy - xw * xy) / (xx * ww - xw * xw), n FROM k""", "estimate:3")
def _(t: Feeds) -> DataFrame:
    fit = stats.ols_fixed_effects(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"], "l_linenumber")
    return fit.select("term", "estimate", "n_obs")


@query("t06_daily_load_join", f"""
    SELECT date_local, load_mean_mw, is_free AS is_weekend_or_holiday, month_local, hdd_18 FROM ({DAILY_LOAD})""", "load_mean_mw:8 hdd_18:3")
def _(t: Feeds) -> DataFrame:
    return analytics.daily_load(t.hourly, t.daily)


@query("t07_monthly_spread_share", """
    SELECT count(*) AS months, avg((spread_mean_eur_mwh > 0)::INT)::DOUBLE AS share_up FROM spreadmonthly""", "share_up:8")
def _(t: Feeds) -> DataFrame:
    return analytics.months_with_positive_spread(t.spread)


@query("t07_monthly_spread", "SELECT * FROM spreadmonthly", "spread_mean_eur_mwh share_at_above_de_pct")
def _(t: Feeds) -> DataFrame:
    return t.spread


@query("t08_monthly_modal_regime", """
    SELECT m.year_local, m.month_local, m.price_base_eur_mwh, r.regime FROM monthly m LEFT JOIN (
        SELECT year(date_local)::INT AS y, month(date_local)::INT AS mo, regime, row_number() OVER (PARTITION BY year(date_local), month(date_local) ORDER BY count(*) DESC, regime) AS rn
        FROM labelled GROUP BY 1, 2, 3, year(date_local), month(date_local)) r ON r.y = m.year_local AND r.mo = m.month_local AND r.rn = 1""", "price_base_eur_mwh")
def _(t: Feeds) -> DataFrame:
    return analytics.monthly_modal_regime(t.labelled, t.monthly)
