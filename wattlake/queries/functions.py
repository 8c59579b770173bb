"""Scalar functions, each applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.config import MAIN_PROFILE
from wattlake.functions import exprs, hashing, text
from wattlake.functions import timecols as tc
from wattlake.queries.feeds import Feeds
from wattlake.queries.oracle import checksum_sql
from wattlake.queries.registry import query
from wattlake.queries.windows import NUMBERS, numbers


@query("f01_date_trunc", """
    SELECT event_id, date_trunc('hour', ts) AS hour_start, date_trunc('month', ts)::DATE AS month_start FROM events""")
def _(t: Feeds) -> DataFrame:
    return t.events.select("event_id", F.date_trunc("hour", "ts").alias("hour_start"), F.trunc("ts", "MM").alias("month_start"))


@query("f02_date_parts", """
    SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d,
           make_date(year(o_orderdate)::INT, month(o_orderdate)::INT, 1) AS month_start FROM orders""")
def _(t: Feeds) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"),
                           tc.month_of(F.year(d), F.month(d)).alias("month_start"))


@query("f03_parse_month", """
    SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y-%m'), '%Y-%m')::DATE AS month_start FROM orders""")
def _(t: Feeds) -> DataFrame:
    label = F.date_format("o_orderdate", "yyyy-MM")
    return t.orders.select("o_orderkey", F.to_date(label, "yyyy-MM").alias("month_start"))


@query("f04_day_of_week", """
    SELECT DISTINCT o_orderdate::DATE AS day, dayofweek(o_orderdate)::INT AS dow_sunday0, (isodow(o_orderdate) - 1)::INT AS dow_monday0,
           make_date(year(o_orderdate)::INT, 3, 31) - dayofweek(make_date(year(o_orderdate)::INT, 3, 31))::INT AS last_sunday_march FROM orders""")
def _(t: Feeds) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.orders.select(
        d.alias("day"), tc.dow_sunday0(d).alias("dow_sunday0"), tc.dow_monday0(d).alias("dow_monday0"),
        tc.last_sunday(F.year(d), 3).alias("last_sunday_march")).distinct()


@query("f05_leap_year", """
    SELECT DISTINCT year(l_shipdate)::INT AS y, year(l_shipdate) % 4 = 0 AND (year(l_shipdate) % 100 <> 0 OR year(l_shipdate) % 400 = 0) AS is_leap FROM lineitem""")
def _(t: Feeds) -> DataFrame:
    y = F.year("l_shipdate")
    return t.lineitem.select(y.alias("y"), tc.is_leap_year(y).alias("is_leap")).distinct()


@query("f06_zone_conversion", """
    SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Vienna' AS local_ts, ts AS back_utc FROM events""")
def _(t: Feeds) -> DataFrame:
    local = tc.local_time(F.col("ts"))
    return t.events.select("event_id", local.alias("local_ts"), tc.utc_of_local(local).alias("back_utc"))


@query("f06_hours_in_local_day", "SELECT date_local, count(*)::INT AS hours FROM cal GROUP BY 1")
def _(t: Feeds) -> DataFrame:
    days = t.calendar.select("date_local").distinct()
    return days.select("date_local", tc.hours_in_local_day(F.col("date_local")).alias("hours"))


@query("f07_peak_hour", """
    SELECT zone, c.is_peak_hour, count(*) AS n FROM raw_prices r JOIN cal c ON c.ts_utc = date_trunc('hour', r.ts_utc) GROUP BY 1, 2""")
def _(t: Feeds) -> DataFrame:
    from wattlake.operators.spine import holiday_dimension

    local = tc.local_time(F.col("ts_utc"))
    rows = t.raw_prices.select("zone", F.to_date(local).alias("day"), F.hour(local).alias("hour"))
    years = t.bounds.select(F.explode(F.sequence(F.year("first_day") - 1, F.year("last_day") + 1)).alias("year"))
    # Thirteen holidays a year: a bounded side table.
    holidays = F.broadcast(holiday_dimension(years).select(F.col("date_local").alias("day"), F.lit(True).alias("h")))
    peak = tc.is_peak_hour(tc.dow_monday0(F.col("day")), F.col("hour"), F.col("h").isNotNull())
    return rows.join(holidays, "day", "left").groupBy("zone", peak.alias("is_peak_hour")).agg(F.count("*").alias("n"))


@query("f08_month_arithmetic", """
    SELECT o_orderkey, date_trunc('month', o_orderdate + INTERVAL 1 MONTH)::DATE AS next_month, last_day(o_orderdate) AS month_end,
           (o_orderdate::DATE + INTERVAL 18 MONTH)::DATE AS later FROM orders""")
def _(t: Feeds) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.trunc(F.add_months(d, 1), "MM").alias("next_month"),
                           F.last_day(d).alias("month_end"), F.add_months(d, 18).alias("later"))


@query("f09_now_minus_interval", """
    SELECT count(*) AS n, count(*) FILTER (WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 40 DAY) AS recent FROM orders""")
def _(t: Feeds) -> DataFrame:
    # "Now" is a parameter; here it is the newest order.
    now = t.orders.agg(F.max("o_orderdate")).scalar()
    rows = t.orders.withColumn("now", now)
    recent = F.col("o_orderdate") >= F.col("now") - F.make_dt_interval(days=F.lit(40))
    return rows.agg(F.count("*").alias("n"), F.count_if(recent).alias("recent"))


@query("f10_numeric_functions", """
    SELECT l_orderkey, l_linenumber, greatest(0.0::DOUBLE, l_quantity - 25) AS over, coalesce(nullif(l_discount, 0), -1) AS disc,
           abs(l_quantity - 25) AS dist, ceil(l_quantity * 0.05)::BIGINT AS tail, (l_orderkey % 7)::BIGINT AS rest,
           round(l_extendedprice / 977.0, 3) AS rounded FROM lineitem""")
def _(t: Feeds) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.greatest(F.lit(0.0), q - 25).alias("over"),
        F.coalesce(F.nullif(F.col("l_discount"), F.lit(0.0)), F.lit(-1.0)).alias("disc"), F.abs(q - 25).alias("dist"),
        F.ceil(q * 0.05).alias("tail"), (F.col("l_orderkey") % 7).alias("rest"),
        F.round(F.col("l_extendedprice") / 977.0, 3).alias("rounded"))


@query("f10_null_safe_degree_days", """
    SELECT date_local, any_value(hdd_18) AS hdd_18, any_value(cdd_22) AS cdd_22 FROM dimcal GROUP BY 1""", "hdd_18:3 cdd_22:3")
def _(t: Feeds) -> DataFrame:
    days = t.calendar.select("date_local").distinct().join(t.weather, "date_local", "left")
    return days.select("date_local", exprs.heating_degrees(F.col("tavg_c")).alias("hdd_18"),
                       exprs.cooling_degrees(F.col("tavg_c")).alias("cdd_22"))


@query("f11_clip_and_floor_division", """
    SELECT l_orderkey, l_linenumber, greatest(l_quantity, 10.0::DOUBLE) AS clipped, floor(l_extendedprice / 1000)::BIGINT AS bin FROM lineitem""")
def _(t: Feeds) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", exprs.clip_low(F.col("l_quantity"), 10.0).alias("clipped"),
                             F.floor(F.col("l_extendedprice") / 1000).alias("bin"))


@query("f12_string_functions", """
    SELECT c_custkey, printf('%04d-%02d', 1990 + c_nationkey, c_nationkey % 12 + 1) AS month_key, split_part(c_name, '#', 1) AS prefix,
           lower(trim(' ' || c_mktsegment || ' ')) AS segment, lpad(c_nationkey::VARCHAR, 4, '0') AS padded,
           regexp_extract(c_name, '#0*(\\d+)$', 1) AS number, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer""")
def _(t: Feeds) -> DataFrame:
    nation = F.col("c_nationkey")
    return t.table("customer").select(
        "c_custkey", tc.month_label(nation + 1990, nation % 12 + 1).alias("month_key"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("prefix"),
        F.lower(F.trim(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")))).alias("segment"),
        F.lpad(nation.cast("string"), 4, "0").alias("padded"),
        F.regexp_extract("c_name", r"#0*(\d+)$", 1).alias("number"), F.regexp_replace("c_name", "[^0-9]", "").alias("digits"))


@query("f13_year_checksum", """
    SELECT year_local, sha256(string_agg(strftime(ts_utc, '%Y-%m-%dT%H:%M:%S+00:00') || ',' || printf('%.6f', load_mwh), chr(10) ORDER BY ts_utc)) AS sha256
    FROM conload WHERE profile = 'main' GROUP BY 1""")
def _(t: Feeds) -> DataFrame:
    return hashing.series_checksum(t.main_load, ["year_local"], "ts_utc", "load_mwh")


@query("f14_table_checksum", f"""
    SELECT 'orders' AS table_name, count(*) AS n_rows, {checksum_sql("d")} AS checksum FROM (
        SELECT md5(concat_ws(chr(31), o_orderkey, o_custkey, o_orderstatus, o_totalprice::VARCHAR, o_orderdate::TIMESTAMP::VARCHAR, o_orderpriority)) AS d FROM orders)""")
def _(t: Feeds) -> DataFrame:
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return hashing.table_checksum(t.orders.select(*columns), "orders")


@query("f15_array_and_map_lookup", """
    SELECT event_id, weekday[hour(ts) + 1] AS shape_value, seasonal[month(ts)] AS factor FROM events CROSS JOIN shape""")
def _(t: Feeds) -> DataFrame:
    shape = F.array(*[F.lit(v) for v in MAIN_PROFILE.weekday])
    factors = F.create_map(*[x for m, v in enumerate(MAIN_PROFILE.seasonal, 1) for x in (F.lit(m), F.lit(v))])
    return t.events.select("event_id", F.element_at(shape, F.hour("ts") + 1).alias("shape_value"),
                           F.element_at(factors, F.month("ts")).alias("factor"))


@query("f16_exploded_series", """
    SELECT o_orderkey, unnest(generate_series(o_orderdate, o_orderdate + to_days((o_custkey % 3)::INT), INTERVAL 1 DAY))::DATE AS day FROM orders""")
def _(t: Feeds) -> DataFrame:
    d = F.to_date("o_orderdate")
    days = F.sequence(d, F.date_add(d, (F.col("o_custkey") % 3).cast("int")), F.expr("interval 1 day"))
    return t.orders.select("o_orderkey", F.explode(days).alias("day"))


@query("f17_json_and_xml_paths", """
    SELECT event_id, (props->>'$.k')::INT AS k, event_type AS tag FROM events""")
def _(t: Feeds) -> DataFrame:
    xml = F.concat(F.lit("<e><type>"), F.col("event_type"), F.lit("</type></e>"))
    rows = t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), xml.alias("x"))
    return rows.select("event_id", "k", F.xpath_string("x", F.lit("e/type")).alias("tag"))


@query("f18_wrapping_window", """
    SELECT o_orderkey, strftime(o_orderdate, '%m-%d') >= '12-24' OR strftime(o_orderdate, '%m-%d') <= '01-01' AS in_shutdown,
           strftime(o_orderdate, '%m-%d') BETWEEN '03-01' AND '05-31' AS in_spring FROM orders""")
def _(t: Feeds) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", tc.month_day_in_window(d, "12-24", "01-01").alias("in_shutdown"),
                           tc.month_day_in_window(d, "03-01", "05-31").alias("in_spring"))


@query("f19_first_week_of_august", """
    SELECT o_orderkey, o_orderdate::DATE BETWEEN m AND m + 6 AS in_maintenance FROM orders JOIN monday ON y = year(o_orderdate)""")
def _(t: Feeds) -> DataFrame:
    d = F.to_date("o_orderdate")
    monday = tc.first_monday_of_august(F.year(d))
    return t.orders.select("o_orderkey", d.between(monday, F.date_add(monday, 6)).alias("in_maintenance"))


@query("f20_safe_divide", """
    SELECT l_orderkey, l_linenumber, l_tax / nullif(l_discount, 0) AS ratio FROM lineitem""", "ratio:8")
def _(t: Feeds) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", exprs.ratio(F.col("l_tax"), F.col("l_discount")).alias("ratio"))


def composed_texts(t: Feeds) -> DataFrame:
    """Whole documents with a published figure appended, some right and some off, and amounts in other forms.

    The numbers table has one row per published key, so Spark broadcasts it by
    its measured size. A document without such a key keeps its own text.
    """
    kinds = F.array(*[F.lit(k) for k in ("wrong_strategy_cost_", "neg_hours_", "annual_mean_price_")])
    key = F.concat(F.get(kinds, (F.col("doc_id") % 3).cast("int")), (F.col("doc_id") % 5 + 1996).cast("string"))
    off = F.when(F.col("doc_id") % 4 == 0, F.lit("9")).otherwise(F.lit(""))
    texts = t.table("documents").select("doc_id", "text", key.alias("key"))
    figure = F.concat(F.lit(" cost "), off, F.col("value"), F.lit(" "), F.col("unit"), F.lit(" total "))
    part = (F.col("doc_id") % 90 + 10).cast("string")
    other = (
        F.when(F.col("doc_id") % 6 == 1, F.concat(F.lit(" spent €1,2"), part, F.lit(".5 M of € "), part, F.lit(" left ")))
        .when(F.col("doc_id") % 6 == 2, F.concat(F.lit(" share "), part, F.lit(".25% or "), part, F.lit(" % here ")))
        .otherwise(F.lit(""))
    )
    joined = texts.join(numbers(t).select("key", "value", "unit"), "key", "left")
    return joined.select("doc_id", F.concat(F.col("text"), F.coalesce(figure, F.lit("")), other).alias("text"))


# The oracle restates the search with its own engine's regular expressions: RE2
# has no look-around, so the left context is matched and the right one checked
# by the order of the unit alternatives.
COMPOSED = f"""
    SELECT doc_id, text || coalesce(' cost ' || CASE WHEN doc_id % 4 = 0 THEN '9' ELSE '' END || value || ' ' || unit || ' total ', '')
           || CASE doc_id % 6 WHEN 1 THEN ' spent €1,2' || (doc_id % 90 + 10) || '.5 M of € ' || (doc_id % 90 + 10) || ' left '
                              WHEN 2 THEN ' share ' || (doc_id % 90 + 10) || '.25% or ' || (doc_id % 90 + 10) || ' % here ' ELSE '' END AS text
    FROM documents LEFT JOIN ({NUMBERS}) pub
      ON pub.key = CASE doc_id % 3 WHEN 0 THEN 'wrong_strategy_cost_' WHEN 1 THEN 'neg_hours_' ELSE 'annual_mean_price_' END || (1996 + doc_id % 5)"""
RE2_NUMBER = r"-?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
LITERALS = f"""
    SELECT doc_id, literal, value, unit, 0.5::DOUBLE * pow(10.0::DOUBLE, -length(regexp_extract(number, '\\.(\\d+)$', 1))) * scale + 1e-9::DOUBLE AS tolerance
    FROM (SELECT doc_id, literal, unit, scale, number, number::DOUBLE * scale AS value FROM (
        SELECT doc_id, literal, replace(regexp_extract(literal, '{RE2_NUMBER}'), ',', '') AS number,
               CASE WHEN starts_with(literal, '€') AND ends_with(literal, 'M') THEN 1e6::DOUBLE ELSE 1.0::DOUBLE END AS scale,
               CASE WHEN starts_with(literal, '€') THEN 'EUR' WHEN ends_with(literal, 'EUR/MWh') THEN 'EUR/MWh'
                    WHEN ends_with(literal, 'EUR') THEN 'EUR' WHEN ends_with(literal, '%') THEN '%' ELSE 'hours' END AS unit
        FROM (SELECT doc_id, unnest(regexp_extract_all(text,
                  '(?:^|[^\\w.%-])((?:{RE2_NUMBER})\\s?(?:EUR/MWh|EUR\\b|%|hours\\b))', 1)) AS literal FROM ({COMPOSED})
              UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '€\\s?{RE2_NUMBER}(?:\\s?M\\b)?')) FROM ({COMPOSED}))))"""


@query("f22_number_literals", LITERALS, "value:2 tolerance:12")
def _(t: Feeds) -> DataFrame:
    return text.number_literals(composed_texts(t), "doc_id", "text")


@query("f22_number_literals_by_unit", f"SELECT unit, count(*) AS n FROM ({LITERALS}) GROUP BY 1")
def _(t: Feeds) -> DataFrame:
    return text.number_literals(composed_texts(t), "doc_id", "text").groupBy("unit").agg(F.count("*").alias("n"))
