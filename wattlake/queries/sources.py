"""Scans, ingestion transforms and document flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.config import LOOKBACK_DAYS, PLANT_TYPE_NAMES
from wattlake.functions.exprs import code_name
from wattlake.operators import spine
from wattlake.operators.dedup import drop_refetched, latest_wins
from wattlake.operators.series import gap_minutes
from wattlake.plans import gates
from wattlake.queries.feeds import Feeds
from wattlake.queries.registry import query
from wattlake.session import scratch_dir
from wattlake.sources import documents as docs
from wattlake.sources import snapshots, tables


@query("s01_parquet_tree_union_by_name", """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, NULL::BIGINT AS s_suppkey, NULL::VARCHAR AS s_name FROM customer
    UNION ALL SELECT NULL, NULL, NULL, NULL, s_suppkey, s_name FROM supplier""")
def _(t: Feeds) -> DataFrame:
    tree = t.spark.read.option("pathGlobFilter", "{customer,supplier}.parquet").option(
        "mergeSchema", "true").option("recursiveFileLookup", "true").parquet(t.sf_dir)
    return tree.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "s_suppkey", "s_name")


@query("s02_parquet_file", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def _(t: Feeds) -> DataFrame:
    part = tables.read_parquet(t.spark, f"{t.sf_dir}/part.parquet")
    return part.select("p_partkey", "p_brand", "p_retailprice")


INDEX_SQL = """
    SELECT strftime(month_local, '%Y-%m') AS month, printf('%.4f', oespi_base) AS oespi_base,
           printf('%.4f', oespi_peak) AS oespi_peak FROM idx"""


def index_text(t: Feeds) -> DataFrame:
    return t.index.select(
        F.date_format("month_local", "yyyy-MM").alias("month"),
        F.format_string("%.4f", "oespi_base").alias("oespi_base"),
        F.format_string("%.4f", "oespi_peak").alias("oespi_peak"),
        F.lit("https://example.org/index").alias("source_url"), F.lit("2002-01-01").alias("retrieved_at"))


def index_csv(t: Feeds) -> str:
    path = f"{scratch_dir(t.spark)}/index"
    index_text(t).write.option("header", "true").csv(path)
    return path


@query("s03_csv_with_header", f"SELECT month, oespi_base::DOUBLE AS oespi_base FROM ({INDEX_SQL})")
def _(t: Feeds) -> DataFrame:
    schema = "month STRING, oespi_base DOUBLE, oespi_peak DOUBLE, source_url STRING, retrieved_at STRING"
    return tables.read_csv(t.spark, index_csv(t), schema).select("month", "oespi_base")


@query("s04_index_contract_load", f"""
    SELECT (month || '-01')::DATE AS month_local, oespi_base::DOUBLE AS oespi_base, oespi_peak::DOUBLE AS oespi_peak,
           true AS peak_available FROM ({INDEX_SQL})""")
def _(t: Feeds) -> DataFrame:
    typed, peak_available = tables.load_index(tables.read_index_text(t.spark, index_csv(t)))
    return typed.withColumn("peak_available", F.lit(peak_available))


@query("s05_sql_over_path", """
    SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders
    WHERE o_totalprice >= 100000 GROUP BY 1""")
def _(t: Feeds) -> DataFrame:
    return t.spark.sql(
        f"SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM parquet.`{t.sf_dir}/orders.parquet` "
        "WHERE o_totalprice >= :floor GROUP BY 1", args={"floor": 100000})


@query("s06_seed_table_join", """
    SELECT c.strategy_id, strategy_name, description, count(*) AS months
    FROM costs c JOIN dimstrategy d ON d.strategy_id = c.strategy_id GROUP BY 1, 2, 3""")
def _(t: Feeds) -> DataFrame:
    dim = F.broadcast(tables.strategy_dimension(t.spark))
    return t.costs.join(dim, "strategy_id").groupBy("strategy_id", "strategy_name", "description").agg(
        F.count("*").alias("months"))


# ---- market documents composed from events ----------------------------------
AREA = {"view": "10YAT-APG------L", "signup": "10YAT-APG------L", "error": "10YAT-APG------L",
        "click": "10Y1001A1001A82H", "purchase": "10YCH-SWISSGRIDZ"}
PLANT = {"view": "B16", "click": "B10", "purchase": "B01", "signup": "B99", "error": "B10"}


def _tag(name: str, value: Column | str) -> Column:
    inner = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name.split(' ')[0]}>"))


def _per_type(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("event_type")]


def _period(points: Column, step: str) -> Column:
    day = F.date_format("day", "yyyy-MM-dd")
    following = F.date_format(F.date_add("day", 1), "yyyy-MM-dd")
    interval = _tag("timeInterval", F.concat(
        _tag("start", F.concat(day, F.lit("T00:00Z"))), _tag("end", F.concat(following, F.lit("T00:00Z")))))
    return _tag("Period", F.concat(interval, _tag("resolution", step), points))


def _points(value: str, tag: str) -> Column:
    """Points of one document in position order (24 or 96 at most)."""
    rows = F.array_sort(F.collect_list(F.struct("position", F.format_string("%.2f", F.col(value)).alias("v"))))
    return F.array_join(F.transform(rows, lambda r: F.concat(
        F.lit("<Point><position>"), r["position"].cast("string"), F.lit(f"</position><{tag}>"), r["v"],
        F.lit(f"</{tag}></Point>"))), "")


def price_documents(t: Feeds) -> DataFrame:
    """One document per event type and day: hourly A03 curve, omitted hours to be filled.

    ``click`` carries a second unclassified series at the hourly maximum,
    ``signup`` is classified 2, ``error`` is quoted in USD.
    """
    hourly = t.events.groupBy("event_type", F.to_date("ts").alias("day"), (F.hour("ts") + 1).alias("position")).agg(
        F.min("value").alias("low"), F.max("value").alias("top"))
    daily = hourly.groupBy("event_type", "day").agg(
        _points("low", "price.amount").alias("p1"), _points("top", "price.amount").alias("p2"))
    kind = F.col("event_type")

    def series(points: str) -> Column:
        currency = F.when(kind == "error", "USD").otherwise("EUR")
        position = F.when(kind == "view", "1").when(kind == "signup", "2")
        return _tag("TimeSeries", F.concat(
            F.coalesce(_tag(docs.POSITION, position), F.lit("")), _tag("businessType", "A62"),
            _tag('in_Domain.mRID codingScheme="A01"', _per_type(AREA)),
            _tag("currency_Unit.name", currency), _tag("price_Measure_Unit.name", "MWH"), _tag("curveType", "A03"),
            _period(F.col(points), "PT60M")))

    second = F.when(kind == "click", series("p2")).otherwise(F.lit(""))
    namespace = 'xmlns="urn:iec62325.351:tc57wg16:451-3:publicationdocument:7:3"'
    return daily.select(
        F.concat_ws(":", kind, F.col("day").cast("string")).alias("doc_id"),
        _tag(f"Publication_MarketDocument {namespace}", F.concat(series("p1"), second)).alias("xml"))


def generation_documents(t: Feeds) -> DataFrame:
    """One document per event type and day with quarter-hour quantities."""
    quarter = (F.hour("ts") * 4 + F.floor(F.minute("ts") / 15) + 1).cast("int")
    rows = t.events.groupBy("event_type", F.to_date("ts").alias("day"), quarter.alias("position")).agg(
        F.max("value").alias("low"))
    daily = rows.groupBy("event_type", "day").agg(_points("low", "quantity").alias("p"))
    business = F.when(F.col("event_type") == "error", "A04").otherwise("A01")
    return daily.select(
        F.concat_ws(":", "event_type", F.col("day").cast("string")).alias("doc_id"),
        _tag("GL_MarketDocument", _tag("TimeSeries", F.concat(
            _tag("businessType", business), _tag('in_Domain.mRID codingScheme="A01"', _per_type(AREA)),
            _tag("MktPSRType", _tag("psrType", _per_type(PLANT))), _tag("curveType", "A01"),
            _period(F.col("p"), "PT15M")))).alias("xml"))


HOURLY_POINTS = """
    SELECT event_type || ':' || ts::DATE AS doc_id, event_type, ts::DATE AS day, hour(ts)::INT + 1 AS position,
           min(value) AS low, max(value) AS top
    FROM events GROUP BY 1, 2, 3, 4"""
ZONE = """CASE event_type WHEN 'click' THEN 'DE_LU' WHEN 'purchase' THEN '10YCH-SWISSGRIDZ' ELSE 'AT' END"""


@query("s07_market_document_flattening", f"""
    SELECT doc_id, 0 AS series_no, day + to_hours(position - 1) AS ts_utc, low AS value, 'PT60M' AS resolution, {ZONE} AS zone
    FROM ({HOURLY_POINTS})
    UNION ALL SELECT doc_id, 1, day + to_hours(position - 1), top, 'PT60M', {ZONE} FROM ({HOURLY_POINTS}) WHERE event_type = 'click'""")
def _(t: Feeds) -> DataFrame:
    series = docs.describe_series(docs.parse_market_documents(price_documents(t), "doc_id", "xml"))
    points = docs.explode_points(docs.explode_periods(series))
    return points.select("doc_id", "series_no", "ts_utc", "value", "resolution", "zone")


#: Faults by day of the month: a cut document, a bad number, a missing interval, an empty document.
SPOILED = {1: "unreadable document", 2: "not a number", 3: "missing time interval", 4: "neither series nor acknowledgement"}


@query("s07_rejected_documents", f"""
    SELECT doc_id, reason FROM (SELECT DISTINCT doc_id, day(day) AS d FROM ({HOURLY_POINTS}))
    JOIN (VALUES {", ".join(f"({k}, '{v}')" for k, v in SPOILED.items())}) AS t(k, reason) ON k = d % 9""")
def _(t: Feeds) -> DataFrame:
    """Documents spoiled on some days; every one is listed and no other."""
    day = F.dayofmonth(F.to_date(F.element_at(F.split("doc_id", ":"), 2))) % 9
    xml = F.col("xml")
    spoiled = (
        F.when(day == 1, F.substring(xml, F.lit(1), F.length(xml) - 40))
        .when(day == 2, F.regexp_replace(xml, "<price.amount>[^<]*<", "<price.amount>n/a<"))
        .when(day == 3, F.regexp_replace(xml, "<timeInterval>.*?</timeInterval>", ""))
        .when(day == 4, F.regexp_replace(xml, "<TimeSeries>.*</TimeSeries>", ""))
        .otherwise(xml)
    )
    return docs.rejected_documents(price_documents(t).withColumn("xml", spoiled), "doc_id", "xml")


@query("s08_curve_position_fill", f"""
    SELECT d.doc_id, d.series_no::INT AS series_no, g.position::INT AS position, day + to_hours(g.position::INT - 1) AS ts_utc,
           last_value(v IGNORE NULLS) OVER (PARTITION BY d.doc_id, d.series_no ORDER BY g.position) AS value,
           (24 - count(v) OVER (PARTITION BY d.doc_id, d.series_no))::INT AS n_filled
    FROM (SELECT DISTINCT doc_id, day, series_no FROM ({HOURLY_POINTS}), (SELECT unnest([0, 1]) AS series_no)
          WHERE series_no = 0 OR event_type = 'click') d
    CROSS JOIN (SELECT unnest(range(1, 25)) AS position) g
    LEFT JOIN (SELECT doc_id, position, s, CASE s WHEN 0 THEN low ELSE top END AS v
               FROM ({HOURLY_POINTS}), (SELECT unnest([0, 1]) AS s)) p
      ON p.doc_id = d.doc_id AND p.position = g.position AND p.s = d.series_no""")
def _(t: Feeds) -> DataFrame:
    points = docs.flatten_points(price_documents(t), "doc_id", "xml")
    return points.select("doc_id", "series_no", "position", "ts_utc", "value", "n_filled")


@query("s08_unseeded_periods", f"""
    SELECT doc_id, 0 AS series_no, 0 AS period_no, 24 AS n_positions FROM ({HOURLY_POINTS}) GROUP BY doc_id HAVING min(position) > 1
    UNION ALL SELECT doc_id, 1, 0, 24 FROM ({HOURLY_POINTS}) WHERE event_type = 'click' GROUP BY doc_id HAVING min(position) > 1""")
def _(t: Feeds) -> DataFrame:
    series = docs.describe_series(docs.parse_market_documents(price_documents(t), "doc_id", "xml"))
    return docs.unseeded_periods(docs.explode_periods(series))


@query("s09_classified_series_kept", f"""
    SELECT {ZONE} AS zone, count(*) AS n FROM ({HOURLY_POINTS}) JOIN (SELECT unnest([0, 1]) AS s) ON s = 0 OR event_type = 'click'
    WHERE event_type <> 'signup' GROUP BY 1""")
def _(t: Feeds) -> DataFrame:
    series = docs.describe_series(docs.parse_market_documents(price_documents(t), "doc_id", "xml"))
    points = docs.explode_points(docs.explode_periods(series))
    return docs.price_rows(points).groupBy("zone").agg(F.count("*").alias("n"))


@query("s09_conflicting_series", f"""
    SELECT doc_id, 'DE_LU' AS zone, day + to_hours(position - 1) AS ts_utc, 2::BIGINT AS n_series, 2::BIGINT AS n_prices
    FROM ({HOURLY_POINTS}) WHERE event_type = 'click' AND low <> top""")
def _(t: Feeds) -> DataFrame:
    series = docs.describe_series(docs.parse_market_documents(price_documents(t), "doc_id", "xml"))
    return docs.conflicting_series(docs.explode_points(docs.explode_periods(series)))


@query("s10_currency_unit_violations", f"""
    SELECT DISTINCT doc_id, 0 AS series_no, 'USD' AS currency, 'MWH' AS unit FROM ({HOURLY_POINTS}) WHERE event_type = 'error'""")
def _(t: Feeds) -> DataFrame:
    series = docs.describe_series(docs.parse_market_documents(price_documents(t), "doc_id", "xml"))
    return docs.unit_violations(series)


@query("s11_code_names", """
    SELECT c.psr_type, coalesce(p.psr_name, 'UNKNOWN(' || c.psr_type || ')') AS psr_name, n
    FROM (SELECT 'B' || lpad((l_partkey % 24 + 1)::VARCHAR, 2, '0') AS psr_type, count(*) AS n FROM lineitem GROUP BY 1) c
    LEFT JOIN psr p ON p.psr_type = c.psr_type""")
def _(t: Feeds) -> DataFrame:
    counts = t.raw_gen.groupBy("psr_type").agg(F.count("*").alias("n"))
    return counts.select("psr_type", code_name(F.col("psr_type"), PLANT_TYPE_NAMES).alias("psr_name"), "n")


@query("s12_generation_rows", f"""
    SELECT day + to_minutes(15 * (q - 1)) AS ts_utc, psr AS psr_type,
           CASE psr WHEN 'B16' THEN 'Solar' WHEN 'B10' THEN 'Hydro Pumped Storage' WHEN 'B01' THEN 'Biomass'
                ELSE 'UNKNOWN(B99)' END AS psr_name,
           CASE WHEN event_type = 'error' THEN 'consumption' ELSE 'aggregated' END AS kind,
           value_mw, 'PT15M' AS resolution, {ZONE} AS zone
    FROM (SELECT event_type, ts::DATE AS day, hour(ts) * 4 + minute(ts) // 15 + 1 AS q,
                 CASE event_type WHEN 'view' THEN 'B16' WHEN 'purchase' THEN 'B01' WHEN 'signup' THEN 'B99' ELSE 'B10' END AS psr,
                 max(value) AS value_mw FROM events GROUP BY 1, 2, 3)""")
def _(t: Feeds) -> DataFrame:
    return docs.generation_rows(docs.flatten_points(generation_documents(t), "doc_id", "xml"))


@query("s12_load_rows", f"""
    SELECT day + to_minutes(15 * (q - 1)) AS ts_utc, load_mw, 'PT15M' AS resolution, {ZONE} AS zone
    FROM (SELECT event_type, ts::DATE AS day, hour(ts) * 4 + minute(ts) // 15 + 1 AS q,
                 max(value) AS load_mw FROM events GROUP BY 1, 2, 3)""")
def _(t: Feeds) -> DataFrame:
    return docs.load_rows(docs.flatten_points(generation_documents(t), "doc_id", "xml"))


@query("s13_weather_json_flattening", """
    SELECT date_local AS date, 'st' || month(date_local) AS station_id, tavg_c AS tl_mittel_c, tavg_c::VARCHAR AS parameter_raw
    FROM weather""", "tl_mittel_c:1")
def _(t: Feeds) -> DataFrame:
    """Monthly documents with parallel arrays, at most 31 entries each."""
    rows = F.array_sort(F.collect_list(F.struct("date", F.col("tl_mittel_c").alias("v"))))
    monthly = t.raw_weather.groupBy(F.trunc("date", "MM").alias("m")).agg(rows.alias("r"))
    data = F.transform("r", lambda x: x["v"])
    stamps = F.transform("r", lambda x: F.concat(x["date"].cast("string"), F.lit("T00:00+00:00")))
    json = F.to_json(F.struct(
        stamps.alias("timestamps"),
        F.array(F.struct(F.struct(F.struct(F.struct(data.alias("data")).alias("tl_mittel")).alias("parameters"))
                         .alias("properties"))).alias("features")))
    documents = monthly.select(F.concat(F.lit("st"), F.month("m").cast("string")).alias("station_id"), json.alias("json"))
    return docs.flatten_weather(documents, "station_id", "json")


@query("s14_longest_record_station", """
    SELECT nation AS nation, id, name, valid_from FROM (
        SELECT s_nationkey AS nation, s_suppkey AS id, s_name AS name,
               strftime(DATE '1950-01-01' + (s_acctbal::INT % 40)::INT, '%Y-%m-%d') || 'T00:00:00+00:00' AS valid_from
        FROM supplier WHERE contains(s_name, '0'))
    QUALIFY row_number() OVER (PARTITION BY nation ORDER BY substr(valid_from, 1, 10)::DATE, NOT contains(name, '7'), id) = 1""")
def _(t: Feeds) -> DataFrame:
    opened = F.date_add(F.lit("1950-01-01").cast("date"), F.rint("s_acctbal").cast("int") % 40)
    stations = t.table("supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.concat(opened.cast("string"), F.lit("T00:00:00+00:00")).alias("valid_from"))
    return docs.longest_record(stations, "0", "7", ["nation"])


@query("s15_resolution_inference", """
    SELECT resolution AS declared, median_minutes, CASE WHEN round(median_minutes) = 60 THEN 'PT60M'
           WHEN round(median_minutes) = 15 THEN 'PT15M' ELSE 'unsupported' END AS resolution
    FROM (SELECT resolution, quantile_cont(round(gap), 0.5) AS median_minutes FROM (
            SELECT resolution, epoch(ts_utc - lag(ts_utc) OVER (PARTITION BY resolution ORDER BY ts_utc)) / 60.0 AS gap
            FROM native WHERE zone = 'AT') WHERE gap IS NOT NULL GROUP BY 1)""", "median_minutes")
def _(t: Feeds) -> DataFrame:
    from wattlake.plans import staging

    native = staging.native_prices(t.raw_prices, "AT").withColumnRenamed("resolution", "declared")
    return docs.infer_resolution(gap_minutes(native, ["declared"], "ts_utc"), ["declared"])


@query("s16_union_of_responses", """
    SELECT o_custkey, day, price, response FROM (
        SELECT *, min(response) OVER (PARTITION BY o_custkey, day, price) AS first_response FROM (
            SELECT o_custkey, o_orderdate::DATE AS day, round(o_totalprice / 50000) AS price, o_orderkey % 7 AS response FROM orders
            UNION ALL SELECT o_custkey, o_orderdate::DATE, round(o_totalprice / 50000), (o_orderkey + 1) % 7 FROM orders))
    WHERE response = first_response""")
def _(t: Feeds) -> DataFrame:
    rows = t.orders.select(
        "o_custkey", F.to_date("o_orderdate").alias("day"),
        F.floor(F.col("o_totalprice") / 50000 + 0.5).cast("double").alias("price"), "o_orderkey")
    first = rows.withColumn("response", F.col("o_orderkey") % 7)
    second = rows.withColumn("response", (F.col("o_orderkey") + 1) % 7)
    both = first.unionByName(second).drop("o_orderkey")
    return drop_refetched(both, "response", ["o_custkey", "day", "price"])


@query("s17_incremental_restatement", f"""
    WITH cut AS (SELECT max(o_orderdate) - INTERVAL {LOOKBACK_DAYS} DAY AS since FROM orders),
         old AS (SELECT o_orderkey, o_orderdate AS ts_utc, o_totalprice AS price FROM orders)
    SELECT strftime(ts_utc, '%Y-%m') AS month, count(*) AS n,
           sum(CASE WHEN date_trunc('month', ts_utc) >= date_trunc('month', since) THEN price + 1 ELSE price END) AS total
    FROM old, cut GROUP BY 1""", "total:2")
def _(t: Feeds) -> DataFrame:
    """Re-ingest the months the lookback touches and publish a snapshot in which exactly those are replaced."""
    from wattlake.operators.joins import with_bounds

    path = f"{scratch_dir(t.spark)}/restated"
    raw = t.orders.select("o_orderkey", F.col("o_orderdate").alias("ts_utc"), F.col("o_totalprice").alias("price"))
    snapshots.replace_months(raw, path, "ts_utc")
    since = raw.agg((F.max("ts_utc") - F.make_dt_interval(days=F.lit(LOOKBACK_DAYS))).alias("since"))
    recent = with_bounds(raw, since).where(F.trunc("ts_utc", "MM") >= F.trunc("since", "MM"))
    snapshots.replace_months(recent.drop("since").withColumn("price", F.col("price") + 1), path, "ts_utc")
    stored = snapshots.read_months(t.spark, path)
    return stored.groupBy(F.date_format("ts_utc", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.sum("price").alias("total"))


@query("s18_latest_complete_month", """
    SELECT CASE WHEN count(*) = (SELECT count(DISTINCT zone) FROM prices) THEN min(latest) END AS latest_complete_month FROM (
        SELECT zone, max(m) AS latest FROM (
            SELECT zone, date_trunc('month', ts_utc)::DATE AS m FROM prices GROUP BY 1, 2
            HAVING count(DISTINCT ts_utc::DATE) = day(last_day(date_trunc('month', ts_utc)::DATE))) GROUP BY 1)""")
def _(t: Feeds) -> DataFrame:
    return gates.latest_complete_month(t.prices)


@query("s19_calendar_spine", "SELECT * FROM cal")
def _(t: Feeds) -> DataFrame:
    return t.spine


@query("s20_holiday_dimension", """
    SELECT y::INT AS year, d AS date_local FROM hol JOIN (SELECT DISTINCT year(o_orderdate) AS oy FROM orders) ON oy = y""")
def _(t: Feeds) -> DataFrame:
    years = t.orders.select(F.year("o_orderdate").alias("year")).distinct()
    return spine.holiday_dimension(years)


@query("s21_horizon_extension", "SELECT d0 AS first_day, d1 AS last_day, (d1 - d0 + 1)::INT AS n_days FROM calbounds")
def _(t: Feeds) -> DataFrame:
    return t.bounds.withColumn("n_days", F.datediff("last_day", "first_day") + 1)


@query("s22_row_provenance", """
    SELECT o_orderkey, '2002-01-01T00:00:00+00:00' AS ingested_at_utc, 'entsoe' AS source,
           sha256(o_custkey || '|' || strftime(o_orderdate, '%Y-%m-%d')) AS request_hash FROM orders""")
def _(t: Feeds) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    stamped = tables.with_provenance(rows, "entsoe_prices_at", "2002-01-01T00:00:00+00:00", ["o_custkey", "day"])
    return stamped.select("o_orderkey", "ingested_at_utc", "source", "request_hash")


@query("w01_latest_wins_prices", "SELECT zone, ts_utc, price_eur_mwh, resolution FROM native", "price_eur_mwh")
def _(t: Feeds) -> DataFrame:
    from wattlake.plans import staging

    return staging.native_prices(t.raw_prices)


@query("w01_latest_wins_lineitem", """
    SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
def _(t: Feeds) -> DataFrame:
    cols = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return latest_wins(t.lineitem.select(*cols), ["l_orderkey", "l_linenumber"], "l_shipdate",
                       ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
