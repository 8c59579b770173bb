"""Data-quality operators: every query returns failing rows or check evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.functions import text
from wattlake.functions import timecols as tc
from wattlake.operators import checks
from wattlake.operators.dedup import duplicate_surplus
from wattlake.operators.spine import holiday_dimension
from wattlake.plans import analytics, gates, strategies
from wattlake.queries.feeds import Feeds
from wattlake.queries.functions import LITERALS, composed_texts
from wattlake.queries.registry import query
from wattlake.queries.windows import NUMBERS, numbers, required_numbers
from wattlake.sources import sinks
from wattlake.sources.schemas import MARTS


@query("q01_unique_and_not_null", """
    SELECT 'unique_orderkey' AS check_id, count(*) - count(DISTINCT o_orderkey) AS n_failed, count(*) = count(DISTINCT o_orderkey) AS passed FROM orders
    UNION ALL SELECT 'not_null_price_delu', count(*) FILTER (WHERE price_delu_eur_mwh IS NULL), count(*) FILTER (WHERE price_delu_eur_mwh IS NULL) = 0 FROM hourly""")
def _(t: Feeds) -> DataFrame:
    repeated = checks.failing_as_check(checks.duplicate_keys(t.orders, ["o_orderkey"]), "unique_orderkey")
    missing = checks.failing_as_check(checks.null_values(t.hourly, "price_delu_eur_mwh"), "not_null_price_delu")
    return checks.gate_report([repeated, missing])


@query("q02_unique_combination", """
    SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t: Feeds) -> DataFrame:
    return checks.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("q03_accepted_ranges", """
    SELECT 'price' AS check_id, count(*) FILTER (WHERE price_at_eur_mwh < -20 OR price_at_eur_mwh > 170) AS n_failed,
           count(*) FILTER (WHERE price_at_eur_mwh < -20 OR price_at_eur_mwh > 170) = 0 AS passed FROM hourly
    UNION ALL SELECT 'load', count(*) FILTER (WHERE load_at_mw < 3000 OR load_at_mw > 12000), count(*) FILTER (WHERE load_at_mw < 3000 OR load_at_mw > 12000) = 0 FROM hourly
    UNION ALL SELECT 'tavg', count(*) FILTER (WHERE tavg_c < -5 OR tavg_c > 25), count(*) FILTER (WHERE tavg_c < -5 OR tavg_c > 25) = 0 FROM daily
    UNION ALL SELECT 'index', count(*) FILTER (WHERE oespi_base <= 0), count(*) FILTER (WHERE oespi_base <= 0) = 0 FROM monthly
    UNION ALL SELECT 'coverage', count(*) FILTER (WHERE coverage_at_pct < 0 OR coverage_at_pct > 100), count(*) FILTER (WHERE coverage_at_pct < 0 OR coverage_at_pct > 100) = 0 FROM dq""")
def _(t: Feeds) -> DataFrame:
    from wattlake.functions.exprs import outside

    # Rules of one table share a single pass.
    hourly = checks.violation_counts(t.hourly, {
        "price": outside(F.col("price_at_eur_mwh"), -20, 170), "load": outside(F.col("load_at_mw"), 3000, 12000)})
    return checks.gate_report([
        hourly, checks.violation_counts(t.daily, {"tavg": outside(F.col("tavg_c"), -5, 25)}),
        checks.violation_counts(t.monthly, {"index": outside(F.col("oespi_base"), low=0, inclusive=False)}),
        checks.violation_counts(t.dq, {"coverage": outside(F.col("coverage_at_pct"), 0, 100)})])


@query("q03_out_of_range_rows", "SELECT event_id, value FROM events WHERE value < 0.5 OR value > 300")
def _(t: Feeds) -> DataFrame:
    return checks.out_of_range(t.events, "value", 0.5, 300).select("event_id", "value")


@query("q04_accepted_values", """
    SELECT event_type, count(*) AS n_rows FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY 1""")
def _(t: Feeds) -> DataFrame:
    return checks.unaccepted_values(t.events, "event_type", ["view", "click", "purchase"])


@query("q05_relationships", """
    SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000)""")
def _(t: Feeds) -> DataFrame:
    solvent = t.table("supplier").where("s_acctbal > 1000")
    return checks.orphans(t.lineitem, solvent, "l_suppkey", "s_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("q06_dst_hour_counts", """
    WITH y AS (SELECT year_local FROM hourly GROUP BY 1 HAVING min(date_local) = make_date(year_local, 1, 1) AND max(date_local) = make_date(year_local, 12, 31)),
    e AS (SELECT make_date(year_local, 3, 31) - dayofweek(make_date(year_local, 3, 31))::INT AS date_local, 23 AS expected_hours FROM y
          UNION ALL SELECT make_date(year_local, 10, 31) - dayofweek(make_date(year_local, 10, 31))::INT, 25 FROM y
          UNION SELECT * FROM (VALUES (DATE '1996-03-31', 23), (DATE '1996-10-27', 25), (DATE '2015-03-29', 23)) v(d, n)),
    a AS (SELECT date_local, count(*) AS n_hours FROM hourly WHERE date_local IN (SELECT date_local FROM e) GROUP BY 1)
    SELECT e.date_local, e.expected_hours, a.n_hours FROM e LEFT JOIN a ON a.date_local = e.date_local
    WHERE n_hours IS NULL OR n_hours <> expected_hours""")
def _(t: Feeds) -> DataFrame:
    return gates.dst_day_failures(t.hourly, [("1996-03-31", 23), ("1996-10-27", 25), ("2015-03-29", 23)])


@query("q07_row_count_per_year", """
    WITH c AS (SELECT year(o_orderdate)::INT AS year_local, count(*) AS n_hours,
           CASE WHEN year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) THEN 8784 ELSE 8760 END AS expected_hours,
           min(o_orderdate)::DATE = make_date(year(o_orderdate)::INT, 1, 1) AND max(o_orderdate)::DATE = make_date(year(o_orderdate)::INT, 12, 31) AS is_complete_year
        FROM orders GROUP BY year(o_orderdate))
    SELECT * FROM c WHERE (is_complete_year AND abs(n_hours - expected_hours) > 24) OR (NOT is_complete_year AND (n_hours < 1 OR n_hours > expected_hours))""")
def _(t: Feeds) -> DataFrame:
    rows = t.orders.select(F.year("o_orderdate").alias("year_local"), F.to_date("o_orderdate").alias("date_local"))
    return gates.year_row_count_failures(rows)


@query("q07_row_count_per_year_hourly", """
    WITH c AS (SELECT year_local, count(*) AS n_hours, CASE WHEN year_local % 4 = 0 AND (year_local % 100 <> 0 OR year_local % 400 = 0) THEN 8784 ELSE 8760 END AS expected_hours,
           min(date_local) = make_date(year_local, 1, 1) AND max(date_local) = make_date(year_local, 12, 31) AS is_complete_year
        FROM hourly WHERE year_local <> 1997 OR date_local NOT IN (DATE '1997-06-01', DATE '1997-06-02') GROUP BY 1)
    SELECT * FROM c WHERE (is_complete_year AND abs(n_hours - expected_hours) > 24) OR (NOT is_complete_year AND (n_hours < 1 OR n_hours > expected_hours))""")
def _(t: Feeds) -> DataFrame:
    # Two days are left out so that the rule has something to find.
    days = F.col("date_local").isin(*[F.lit(d).cast("date") for d in ("1997-06-01", "1997-06-02")])
    return gates.year_row_count_failures(t.hourly.where(~days))


@query("q08_freshness", """
    SELECT event_type, max(ts) AS newest_ts_utc FROM events GROUP BY 1
    HAVING max(ts) < TIMESTAMP '2024-03-15 00:00:00' - INTERVAL 40 DAY""")
def _(t: Feeds) -> DataFrame:
    events = t.events.withColumnRenamed("ts", "ts_utc")
    return gates.stale(events, "ts_utc", F.lit("2024-03-15 00:00:00").cast("timestamp"), keys=["event_type"])


@query("q09_no_gap_months", """
    WITH p AS (SELECT DISTINCT make_date(year_local, month_local, 1) AS m FROM monthly WHERE month_local <> 5 OR year_local <> 1998),
         g AS (SELECT DISTINCT make_date(year_local, month_local, 1) AS m FROM generation),
         c AS (SELECT DISTINCT make_date(year_local, month_local, 1) AS m FROM costs WHERE year_local <> 1999),
         s AS (SELECT unnest(generate_series((SELECT min(m) FROM (SELECT m FROM p UNION ALL SELECT m FROM g)), (SELECT max(m) FROM (SELECT m FROM p UNION ALL SELECT m FROM g)), INTERVAL 1 MONTH))::DATE AS m),
         cs AS (SELECT unnest(generate_series((SELECT min(m) FROM c), (SELECT max(m) FROM c), INTERVAL 1 MONTH))::DATE AS m)
    SELECT 'fct_price_monthly' AS mart_name, 'missing_month' AS failure, m AS month_local FROM s WHERE m NOT IN (SELECT m FROM p)
    UNION ALL SELECT 'fct_generation_monthly', 'missing_month', m FROM s WHERE m NOT IN (SELECT m FROM g)
    UNION ALL SELECT 'fct_procurement_cost_monthly', 'missing_month', m FROM cs WHERE m NOT IN (SELECT m FROM c)
    UNION ALL SELECT 'fct_procurement_cost_monthly', 'outside_price_window', m FROM c WHERE m < (SELECT min(m) FROM p) OR m > (SELECT max(m) FROM p)""")
def _(t: Feeds) -> DataFrame:
    return gates.month_gap_failures(
        t.monthly.where("month_local <> 5 or year_local <> 1998"), t.generation, t.costs.where("year_local <> 1999"))


@query("q10_duplicate_budget", """
    SELECT zone, m AS month, sum(n - 1)::BIGINT AS n_duplicates, 'warn' AS severity FROM (
        SELECT zone, date_trunc('month', ts_utc)::DATE AS m, ts_utc, count(*) AS n FROM raw_prices GROUP BY 1, 2, 3 HAVING count(*) > 1)
    GROUP BY 1, 2 HAVING sum(n - 1) > 30""")
def _(t: Feeds) -> DataFrame:
    from wattlake.config import DUPLICATE_BUDGET_PER_MONTH

    rows = t.raw_prices.select("zone", "ts_utc", F.to_date(F.trunc("ts_utc", "MM")).alias("month"))
    surplus = duplicate_surplus(rows, ["zone", "ts_utc"], ["zone", "month"])
    return surplus.where(F.col("n_duplicates") > DUPLICATE_BUDGET_PER_MONTH).withColumn("severity", F.lit("warn"))


@query("q11_cross_grain_reconciliation", """
    SELECT 1998 AS year, count(*) AS n_failed FROM (
        SELECT m.price_base_eur_mwh AS a, h.a AS b FROM (SELECT price_base_eur_mwh FROM monthly WHERE year_local = 1998 AND month_local = 8) m
        FULL JOIN (SELECT avg(price_at_eur_mwh) AS a FROM hourly WHERE year_local = 1998 AND month_local = 8) h ON true)
    WHERE a IS NULL OR b IS NULL OR abs(a - b) > 0.01""")
def _(t: Feeds) -> DataFrame:
    failed = gates.grain_mismatch(t.hourly, t.monthly, 1998, 8)
    return failed.agg(F.lit(1998).alias("year"), F.count("*").alias("n_failed"))


COMPLETE = """((SELECT min((ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Vienna') FROM {t}) <= make_date({y}::INT, 1, 2)
    AND (SELECT max((ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Vienna') FROM {t}) >= make_date({y}::INT, 12, 31))"""


@query("q13_hour_coverage", f"""
    WITH h AS (SELECT zone, ts_utc, (ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Vienna' AS loc FROM prices),
    c AS (SELECT zone, year(loc)::INT AS year, count(DISTINCT ts_utc) AS actual,
                 CASE WHEN year(loc) % 4 = 0 AND (year(loc) % 100 <> 0 OR year(loc) % 400 = 0) THEN 8784 ELSE 8760 END AS expected FROM h GROUP BY 1, 2, 4),
    d AS (SELECT zone, year(loc)::INT AS year, loc::DATE AS day, count(DISTINCT ts_utc) AS actual FROM h GROUP BY 1, 2, 3)
    SELECT zone, year, 'coverage' AS check, expected::BIGINT AS expected, actual, (expected - actual)::BIGINT AS missing_hours,
           CASE WHEN {COMPLETE.format(t="prices", y="year")} THEN 'complete' ELSE 'boundary' END AS scope,
           CASE WHEN {COMPLETE.format(t="prices", y="year")} THEN expected - actual <= 24 ELSE true END AS ok FROM c
    UNION ALL SELECT zone, year, CASE WHEN month(day) = 3 THEN 'dst_mar' ELSE 'dst_oct' END, n::BIGINT, actual, NULL, 'complete', n = actual
    FROM d JOIN (SELECT date_local, count(*) AS n FROM cal GROUP BY 1) x ON x.date_local = d.day
    WHERE {COMPLETE.format(t="prices", y="year")} AND (day = make_date(year, 3, 31) - dayofweek(make_date(year, 3, 31))::INT
        OR day = make_date(year, 10, 31) - dayofweek(make_date(year, 10, 31))::INT)""")
def _(t: Feeds) -> DataFrame:
    return gates.hour_coverage(t.prices)


@query("q14_price_bounds", "SELECT zone, ts_utc FROM prices WHERE price_eur_mwh < -20 OR price_eur_mwh > 160")
def _(t: Feeds) -> DataFrame:
    return gates.price_plausibility(t.prices, -20.0, 160.0).select("zone", "ts_utc")


BOUNDS = {1995: (50.0, 90.0), 1996: (50.0, 60.0), 1997: (60.0, 95.0), 1998: (70.0, 80.0), 1999: (50.0, 100.0)}


#: Hours in local time, and the span of each zone.
ZONES = """h AS (SELECT zone, ts_utc, price_eur_mwh, (ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Vienna' AS loc FROM prices),
    s AS (SELECT zone, min(loc) AS lo, max(loc) AS hi FROM h GROUP BY 1)"""


@query("q15_annual_mean_plausibility", f"""
    WITH {ZONES}, m AS (SELECT zone, year(loc)::INT AS year, avg(price_eur_mwh) AS mean_price_eur_mwh FROM h GROUP BY 1, 2),
    x AS (SELECT m.*, low, high, CASE WHEN lo <= make_date(year, 1, 2) AND hi >= make_date(year, 12, 31) THEN 'complete' ELSE 'boundary' END AS scope
          FROM m JOIN s USING (zone)
          LEFT JOIN (VALUES (1995, 50.0::DOUBLE, 90.0::DOUBLE), (1996, 50.0, 60.0), (1997, 60.0, 95.0), (1998, 70.0, 80.0), (1999, 50.0, 100.0)) b(y, low, high) ON y = year)
    SELECT *, coalesce(mean_price_eur_mwh BETWEEN low AND high, false) OR scope = 'boundary' AS ok FROM x""", "mean_price_eur_mwh")
def _(t: Feeds) -> DataFrame:
    return gates.annual_mean_plausibility(t.prices, BOUNDS)


@query("q16_negative_prices_present", f"""
    WITH {ZONES}, m AS (SELECT zone, year(loc)::INT AS year, count(*) FILTER (WHERE price_eur_mwh < 0) AS n_negative FROM h GROUP BY 1, 2)
    SELECT zone, year, n_negative, n_negative > 0 AS ok FROM m JOIN s USING (zone)
    WHERE year IN (1996, 1998, 2001) AND lo <= make_date(year, 1, 2) AND hi >= make_date(year, 12, 31)""")
def _(t: Feeds) -> DataFrame:
    return gates.negatives_present(t.prices, [1996, 1998, 2001])


@query("q17_load_plausibility", f"""
    SELECT year, annual_mean_mw, n_out_of_band, scope, n_out_of_band = 0 AND (annual_mean_mw BETWEEN 6000 AND 9000 OR scope = 'boundary') AS ok FROM (
        SELECT year(loc)::INT AS year, avg(load_mw) AS annual_mean_mw, count(*) FILTER (WHERE load_mw < 3000 OR load_mw > 13000) AS n_out_of_band,
               CASE WHEN {COMPLETE.format(t="sysload", y="year(loc)")} THEN 'complete' ELSE 'boundary' END AS scope
        FROM (SELECT load_mw, (ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Vienna' AS loc FROM sysload) GROUP BY year(loc))""", "annual_mean_mw")
def _(t: Feeds) -> DataFrame:
    return gates.load_plausibility(t.load)


@query("q18_join_coverage", f"""
    WITH {ZONES}, l AS (SELECT ts_utc, (ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Vienna' AS loc FROM sysload),
    m AS (SELECT h.zone, year(h.loc)::INT AS year, count(*) AS price_hours, count(l.ts_utc) AS matched_hours
          FROM h LEFT JOIN l ON l.ts_utc = h.ts_utc GROUP BY 1, 2),
    x AS (SELECT m.*, CASE WHEN least(lo, (SELECT min(loc) FROM l)) <= make_date(year, 1, 2)
                            AND greatest(hi, (SELECT max(loc) FROM l)) >= make_date(year, 12, 31) THEN 'complete' ELSE 'boundary' END AS scope
          FROM m JOIN s USING (zone))
    SELECT zone, year, price_hours, matched_hours, round(matched_hours / price_hours, 4) AS coverage, scope,
           matched_hours / price_hours >= 0.995 OR scope = 'boundary' AS ok FROM x""")
def _(t: Feeds) -> DataFrame:
    return gates.join_coverage(t.prices, t.load)


@query("q19_weather_checks", """
    WITH s AS (SELECT count(DISTINCT date_local) FILTER (WHERE tavg_c IS NOT NULL AND date_local BETWEEN DATE '1995-01-01' AND DATE '2000-12-31')::DOUBLE / 2192 AS cov,
               count(*) FILTER (WHERE tavg_c < -30 OR tavg_c > 42) AS n, avg(tavg_c) FILTER (WHERE month(date_local) = 7) AS jul,
               avg(tavg_c) FILTER (WHERE month(date_local) = 1) AS jan FROM weather)
    SELECT 'coverage' AS check, cov AS actual, cov >= 0.99 AS ok FROM s UNION ALL SELECT 'range', n::DOUBLE, n = 0 FROM s
    UNION ALL SELECT 'july_mean', jul, jul IS NULL OR jul BETWEEN 15 AND 30 FROM s UNION ALL SELECT 'january_mean', jan, jan IS NULL OR jan BETWEEN -10 AND 8 FROM s""", "actual:5")
def _(t: Feeds) -> DataFrame:
    return gates.weather_checks(t.weather, F.lit("1995-01-01").cast("date"), F.lit("2000-12-31").cast("date"))


@query("q20_index_checks", """
    WITH s AS (SELECT min(month_local) AS a, max(month_local) AS b, count(*) AS n, count(*) FILTER (WHERE oespi_base <= 0) + count(*) FILTER (WHERE oespi_peak <= 0) AS bad,
                      avg(oespi_base) FILTER (WHERE year(month_local) = 1996) AS calm, max(oespi_base) FILTER (WHERE year(month_local) = 1999) AS top,
                      count(*) FILTER (WHERE abs(mom) > 0.6) AS jumps
               FROM (SELECT *, oespi_base / lag(oespi_base) OVER (ORDER BY month_local) - 1 AS mom FROM idx)),
         m AS (SELECT ((year(b) - year(a)) * 12 + month(b) - month(a) + 1 - n)::DOUBLE AS gaps FROM s)
    SELECT 'continuity' AS check, gaps AS actual, gaps = 0 AS ok FROM m UNION ALL SELECT 'positivity', bad::DOUBLE, bad = 0 FROM s
    UNION ALL SELECT 'crisis_visibility', top / calm, top >= 3 * calm FROM s UNION ALL SELECT 'mom_change', jumps::DOUBLE, jumps = 0 FROM s""", "actual")
def _(t: Feeds) -> DataFrame:
    return gates.index_checks(t.index, 1996, 1999)


@query("q21_calendar_checks", """
    SELECT 'holiday_set' AS check, (SELECT count(*) FROM (SELECT DISTINCT date_local FROM cal WHERE year_local = 1998 AND is_holiday_at
            EXCEPT SELECT d FROM hol WHERE y = 1998)) = 0 AS ok
    UNION ALL SELECT 'fixed_holidays', count(DISTINCT date_local) = 3 FROM cal
        WHERE is_holiday_at AND date_local IN (DATE '1998-01-01', DATE '1998-05-01', DATE '1998-12-25')
    UNION ALL SELECT 'peak_hour_mon_sun', bool_or(is_peak_hour) FILTER (WHERE date_local = DATE '1998-01-12')
        AND NOT bool_or(is_peak_hour) FILTER (WHERE date_local = DATE '1998-01-11') FROM cal WHERE hour_local = 10""")
def _(t: Feeds) -> DataFrame:
    years = t.calendar.select(F.col("year_local").alias("year")).distinct()
    return gates.calendar_checks(t.calendar, holiday_dimension(years), 1998, "1998-01-12", "1998-01-11")


@query("q22_regime_gate", """
    SELECT s.a AS crisis_top2_share, s.b AS calm_year_share, s.a >= 0.7 AND s.b >= 0.6 AS passed FROM (
        SELECT coalesce(avg((regime IN ('elevated', 'crisis'))::INT) FILTER (WHERE date_local BETWEEN DATE '1998-09-01' AND DATE '2000-06-30'), 0.0::DOUBLE) AS a,
               coalesce(avg((regime = 'calm')::INT) FILTER (WHERE year(date_local) = 1996), 0.0::DOUBLE) AS b FROM labelled) s""",
    "crisis_top2_share:8 calm_year_share:8")
def _(t: Feeds) -> DataFrame:
    return analytics.regime_gate(t.labelled, "1998-09-01", "2000-06-30", 1996)


@query("q23_strategy_relations", """
    WITH w AS (SELECT year, max(cost_eur) FILTER (WHERE strategy_id = 'S1') AS a, max(cost_eur) FILTER (WHERE strategy_id = 'S3') AS b,
                      max(cost_eur) FILTER (WHERE strategy_id = 'S4_50') AS h FROM annual GROUP BY 1)
    SELECT 'spot_above_fixed' AS check, year, a > b AS ok FROM w WHERE year = 1998
    UNION ALL SELECT 'hybrid_between', year, h BETWEEN least(a, b) * 0.995 AND greatest(a, b) * 1.005 FROM w
    UNION ALL SELECT 'spot_tail_above_fixed', NULL, max(p95) FILTER (WHERE strategy_id = 'S1') >= max(p95) FILTER (WHERE strategy_id = 'S3')
    FROM risksum WHERE variant = 'unconditional'""")
def _(t: Feeds) -> DataFrame:
    return gates.strategy_relations(strategies.annual_summary(t.costs), t.risk_summary, 1998)


@query("q24_numbers_in_text", f"""
    WITH n AS (SELECT unit, try_cast(value AS DOUBLE) AS v FROM ({NUMBERS}) WHERE try_cast(value AS DOUBLE) IS NOT NULL
               UNION ALL SELECT '%', value::DOUBLE * 100 FROM ({NUMBERS}) WHERE unit = 'share')
    SELECT doc_id, value, unit FROM ({LITERALS}) l
    WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.unit = l.unit AND abs(n.v - l.value) <= l.tolerance)""", "value:2")
def _(t: Feeds) -> DataFrame:
    found = text.number_literals(composed_texts(t), "doc_id", "text")
    return text.unmatched_literals(found, numbers(t)).select("doc_id", "value", "unit")


@query("q25_number_table_problems", f"""
    WITH n AS (SELECT * FROM ({NUMBERS}) UNION ALL SELECT * FROM ({NUMBERS}) WHERE key = 'p_ref_base'
               UNION ALL SELECT 'stray', '1', 'EUR', 'VERIFIED', 'strategies/retrospective'),
    s AS (SELECT unnest(['S1', 'S2', 'S3', 'S4_30', 'S4_50', 'S4_70']) AS s), y AS (SELECT unnest(range(1996, 2001)) AS y),
    need AS (SELECT unnest(['wrong_strategy_cost_total', 'best_strategy_5yr', 'p_ref_base', 'p_ref_peak', 'oespi_base_ref', 'consumer_peak_share',
                            'garch_persistence', 'data_last_month', 'next_month']) AS k
             UNION ALL SELECT f || y FROM (SELECT unnest(['wrong_strategy_cost_', 'annual_mean_price_', 'neg_hours_', 'spread_mean_']) AS f), y
             UNION ALL SELECT 'cost_' || s || '_' || y FROM s, y UNION ALL SELECT f || s FROM (SELECT unnest(['p95_next12m_', 'cvar95_next12m_']) AS f), s)
    SELECT 'missing_key' AS problem, k AS key FROM need WHERE k NOT IN (SELECT key FROM n)
    UNION ALL SELECT 'duplicate_key', key FROM n GROUP BY key HAVING count(*) > 1
    UNION ALL SELECT 'unverified_producer', key FROM n WHERE tag = 'VERIFIED' AND NOT starts_with(produced_by, 'analytics/')""")
def _(t: Feeds) -> DataFrame:
    """Faults are added: a key given twice, one by a producer that cannot verify, one that is required but absent."""
    published = numbers(t)
    stray = t.spark.createDataFrame([("stray", "1", "EUR", "VERIFIED", "strategies/retrospective")], published.schema)
    rows = published.unionByName(published.where("key = 'p_ref_base'")).unionByName(stray)
    return gates.number_table_problems(rows, [*required_numbers(t), "next_month"], ["analytics/"])


@query("q26_write_boundary", """
    SELECT o_orderkey, o_orderdate FROM orders WHERE strftime(o_orderdate, '%Y-%m') <> '1998-05'""")
def _(t: Feeds) -> DataFrame:
    return sinks.out_of_month(t.orders, "o_orderdate", "1998-05").select("o_orderkey", "o_orderdate")


@query("q27_contract_difference", """
    SELECT 'fct_price_monthly' AS mart_name, 2 AS position, 'price_base_eur_mwh double' AS expected, 'price_peak_eur_mwh double' AS actual, (SELECT count(*) FROM monthly) AS n_rows
    UNION ALL SELECT 'fct_price_monthly', 3, 'price_peak_eur_mwh double', 'price_base_eur_mwh double', (SELECT count(*) FROM monthly)""")
def _(t: Feeds) -> DataFrame:
    names = list(t.monthly.columns)
    names[2], names[3] = names[3], names[2]
    found = checks.schema_differences(t.monthly.select(*names).schema, MARTS["fct_price_monthly"])
    rows = [("fct_price_monthly", i, want, have) for i, want, have in found]
    n = t.monthly.agg(F.count("*")).scalar()
    return t.spark.createDataFrame(rows, "mart_name string, position int, expected string, actual string").withColumn("n_rows", n)


@query("q28_gate_report", """
    SELECT 'coverage_rows' AS check_id, count(*) FILTER (WHERE coverage_at_pct < 100) AS n_failed, count(*) FILTER (WHERE coverage_at_pct < 100) = 0 AS passed FROM dq
    UNION ALL SELECT 'duplicate_lines', count(*), count(*) = 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'orphan_orders', count(*), count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'quantity_range', count(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 50), count(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 50) = 0 FROM lineitem
    UNION ALL SELECT 'discount_range', count(*) FILTER (WHERE l_discount > 0.09), count(*) FILTER (WHERE l_discount > 0.09) = 0 FROM lineitem""")
def _(t: Feeds) -> DataFrame:
    from wattlake.functions.exprs import outside

    return checks.gate_report([
        checks.violation_counts(t.dq, {"coverage_rows": F.col("coverage_at_pct") < 100}),
        checks.failing_as_check(checks.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"]), "duplicate_lines"),
        checks.failing_as_check(checks.orphans(t.orders, t.table("customer"), "o_custkey", "c_custkey"), "orphan_orders"),
        checks.violation_counts(t.lineitem, {
            "quantity_range": outside(F.col("l_quantity"), 1, 50), "discount_range": outside(F.col("l_discount"), high=0.09)})])


@query("q29_data_quality_monthly", "SELECT * FROM dq", "coverage_at_pct:3")
def _(t: Feeds) -> DataFrame:
    return checks.assert_contract(t.dq, MARTS["fct_data_quality_monthly"])


@query("q30_quality_indicators", """
    SELECT (DATE '2001-10-01' - last_day(max(make_date(year_local, month_local, 1))))::INT AS freshness_days,
           count(*) FILTER (WHERE coverage_at_pct < 100) AS months_below_full, count(*) FILTER (WHERE resolution <> 'PT60M') AS months_not_hourly,
           sum(n_dst_days)::BIGINT AS dst_days, sum(n_negative_hours)::BIGINT AS negative_hours,
           DATE '2001-10-01' - last_day(max(make_date(year_local, month_local, 1))) < 40 AS is_fresh FROM dq""")
def _(t: Feeds) -> DataFrame:
    return gates.quality_indicators(t.dq, F.lit("2001-10-01").cast("date"))
