"""Gates on passing and failing data, idempotent writers, streaming jobs."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattlake.operators.spine import calendar_spine
from wattlake.plans import gates, marts, staging
from wattlake.session import build_session, require_utc
from wattlake.sources import sinks, tables
from wattlake.sources.schemas import MARTS, ddl
from wattlake.streaming import jobs


@pytest.fixture(scope="module")
def year(spark):
    """One complete local year of hours for one zone."""
    bounds = spark.createDataFrame([(date(2023, 1, 1), date(2023, 12, 31))], "first_day date, last_day date")
    return calendar_spine(bounds).cache()


def hourly(year, zone="AT"):
    return year.select(F.lit(zone).alias("zone"), "ts_utc", F.lit(100.0).alias("price_eur_mwh"))


def failing(df):
    return sorted(r.check for r in df.where("not ok").collect())


def test_hour_coverage(year):
    full = hourly(year)
    assert failing(gates.hour_coverage(full)) == []
    no_day = full.where("not (ts_utc >= '2023-05-01' and ts_utc < '2023-05-03')")
    assert failing(gates.hour_coverage(no_day)) == ["coverage"]
    one_dst_hour = full.where("ts_utc <> '2023-03-26 05:00:00'")
    assert failing(gates.hour_coverage(one_dst_hour)) == ["dst_mar"]
    half = full.where("ts_utc < '2023-06-01'")
    assert [(r.scope, r.ok) for r in gates.hour_coverage(half).collect()] == [("boundary", True)]


def test_price_gates(year):
    full = hourly(year)
    assert gates.annual_mean_plausibility(full, {2023: (70, 140)}).first().ok
    assert not gates.annual_mean_plausibility(full, {2023: (10, 20)}).first().ok
    assert not gates.annual_mean_plausibility(full, {2022: (70, 140)}).first().ok
    assert not gates.negatives_present(full, [2023]).first().ok
    negative = full.withColumn("price_eur_mwh", F.when(F.col("ts_utc") == "2023-07-01 12:00:00", -5.0).otherwise(100.0))
    assert gates.negatives_present(negative, [2023]).first().ok
    assert gates.negatives_present(negative, [2024]).count() == 0
    # Another zone is judged by itself, and by its own span.
    half = full.where("ts_utc < '2023-06-01'").withColumn("zone", F.lit("other"))
    both = {(r.zone, r.year): (r.scope, r.ok) for r in gates.annual_mean_plausibility(full.union(half), {2023: (10, 20)}).collect()}
    zone = full.first().zone
    assert both["other", 2023] == ("boundary", True) and both[zone, 2023] == ("complete", False)
    assert {r.zone for r in gates.negatives_present(negative.unionByName(half), [2023]).collect()} == {zone}
    assert gates.price_plausibility(negative, -1.0, 5000.0).count() == 1


def test_load_and_join_gates(year):
    load = year.select("ts_utc", F.lit(7000.0).alias("load_mw"))
    assert gates.load_plausibility(load).first().ok
    assert not gates.load_plausibility(load.withColumn("load_mw", F.lit(9500.0))).first().ok
    assert gates.join_coverage(hourly(year), load).first().coverage == 1.0
    thin = load.where("hour(ts_utc) <> 3 or month(ts_utc) > 6")
    assert not gates.join_coverage(hourly(year), thin).first().ok
    other = hourly(year).withColumn("zone", F.lit("other")).where("hour(ts_utc) <> 3")
    found = {r.zone: r.ok for r in gates.join_coverage(hourly(year).unionByName(other), thin).where("year = 2023").collect()}
    assert len(found) == 2 and found["other"] and list(found.values()).count(False) == 1


def test_freshness(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),)], "ts timestamp")
    assert gates.stale(df, "ts", F.lit("2024-02-01").cast("timestamp")).count() == 0
    assert gates.stale(df, "ts", F.lit("2024-03-01").cast("timestamp")).count() == 1
    assert gates.stale(df.where("false"), "ts", F.lit("2024-03-01").cast("timestamp")).count() == 1


def test_grain_mismatch(spark):
    hours = spark.createDataFrame([(2022, 8, 10.0), (2022, 8, 20.0)], "year_local int, month_local int, price_at_eur_mwh double")
    monthly = spark.createDataFrame([(2022, 8, 15.0)], "year_local int, month_local int, price_base_eur_mwh double")
    assert gates.grain_mismatch(hours, monthly, 2022, 8).count() == 0
    assert gates.grain_mismatch(hours, monthly.withColumn("price_base_eur_mwh", F.lit(15.1)), 2022, 8).count() == 1
    assert gates.grain_mismatch(hours, monthly, 2022, 9).count() == 1


def test_latest_complete_month_needs_every_zone(spark):
    days = [("AT", datetime(2024, 1, d)) for d in range(1, 32)] + [("AT", datetime(2024, 2, d)) for d in range(1, 30)]
    other = [("DE_LU", datetime(2024, 1, d)) for d in range(1, 32)] + [("DE_LU", datetime(2024, 2, 1))]
    df = spark.createDataFrame(days + other, "zone string, ts_utc timestamp")
    assert gates.latest_complete_month(df).first()[0] == date(2024, 1, 1)
    assert gates.latest_complete_month(df.where("zone = 'AT' or ts_utc > '2024-01-15'")).first()[0] is None


def test_marts_on_hand_made_day(spark, year):
    raw = spark.createDataFrame(
        [(datetime(2023, 6, 5, 10, m), v, "PT15M", z, at) for z in ("AT", "DE_LU") for m, v, at in (
            (0, 10.0, "2023-06-06T00:00:00+00:00"), (15, 20.0, "2023-06-06T00:00:00+00:00"), (30, -30.0, "2023-06-06T00:00:00+00:00"),
            (45, 99.0, "2023-06-06T00:00:00+00:00"), (45, -80.0, "2023-06-07T00:00:00+00:00"))],
        "ts_utc timestamp, price_eur_mwh double, resolution string, zone string, ingested_at_utc string")
    prices = staging.hourly_prices(raw)
    assert {(r.zone, r.price_eur_mwh, r.n_subhours) for r in prices.collect()} == {("AT", -20.0, 4), ("DE_LU", -20.0, 4)}
    weather = spark.createDataFrame([(date(2023, 6, 5), 23.5)], "date_local date, tavg_c double")
    load = spark.createDataFrame([(datetime(2023, 6, 5, 10), 7000.0)], "ts_utc timestamp, load_mw double")
    hours = marts.fct_price_hourly(marts.dim_calendar(year, weather), prices, load)
    assert hours.schema == MARTS["fct_price_hourly"] or hours.columns == MARTS["fct_price_hourly"].names
    row = hours.where("price_at_eur_mwh is not null").collect()
    assert len(row) == 1 and row[0].is_negative_price and row[0].hour_local == 12 and row[0].cdd_22 == 1.5 and row[0].is_peak_hour
    assert hours.count() == 8760 and hours.where("is_negative_price is null").count() == 8759
    index = spark.createDataFrame([(date(2023, 6, 1), 100.0, 90.0), (date(2023, 7, 1), 1.0, 1.0)], "month_local date, oespi_base double, oespi_peak double")
    monthly = marts.fct_price_monthly(hours, index).collect()
    assert [(r.month_local, r.oespi_base, r.price_offpeak_eur_mwh) for r in monthly] == [(6, 100.0, None)]
    dq = marts.fct_data_quality_monthly(hours, prices, weather, index).first()
    assert (dq.expected_hours, dq.priced_hours_at, dq.weather_days, dq.resolution, dq.has_oespi) == (720, 1, 1, "PT15M", True)


def test_month_writer_replaces_only_touched_months(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = [(datetime(2024, m, d), float(d)) for m in (1, 2) for d in range(1, 6)]
    df = spark.createDataFrame(rows, "ts timestamp, v double")
    sinks.write_months(df, path, "ts")
    sinks.write_months(df, path, "ts")
    sinks.write_months(df.where("month(ts) = 2").limit(1).withColumn("v", F.lit(7.0)), path, "ts")
    got = {r.month: (r.n, r.s) for r in spark.read.parquet(path).groupBy("month").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    assert got == {1: (5, 15.0), 2: (1, 7.0)}
    assert sinks.out_of_month(df, "ts", "2024-01").count() == 5


def test_export_is_sorted_and_has_the_contract_header(spark, tmp_path):
    rows = [(2021, 2, "S1", 1.0, 2.0, 2.0), (2020, 1, "S1", 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "year_local int, month_local int, strategy_id string, volume_mwh double, cost_eur double, unit_cost_eur_mwh double")
    sinks.write_export(df, "procurement_cost_monthly", str(tmp_path / "c"))
    lines = [x for f in sorted((tmp_path / "c").glob("*.csv")) for x in f.read_text().splitlines()]
    assert lines[0] == "year_local,month_local,strategy_id,volume_mwh,cost_eur,unit_cost_eur_mwh"
    assert [x.split(",")[0] for x in lines if not x.startswith("year")] == ["2020", "2021"]
    first = sinks.export_manifest({"procurement_cost_monthly": df}).first()
    again = sinks.export_manifest({"procurement_cost_monthly": df.repartition(3)}).first()
    assert first == again and first.n_rows == 2


def test_number_tags_are_enforced(spark):
    bad = spark.createDataFrame([("k", "1", "EUR", "GUESSED", "p")], "key string, value string, unit string, tag string, produced_by string")
    with pytest.raises(Exception, match="unknown tag"):
        sinks.numbers_table(bad).collect()


def test_mart_contract_is_enforced(spark, tmp_path):
    df = spark.createDataFrame([(1.0, datetime(2024, 1, 1))], "load_mwh double, ts_utc timestamp")
    with pytest.raises(ValueError, match="column 0"):
        sinks.write_mart(df, "fct_consumer_load_hourly", str(tmp_path / "x"))


def test_drifting_files_are_united_by_name(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(str(tmp_path / "t/2023/a"))
    spark.createDataFrame([("b", 2, 1.5)], "v string, k int, w double").write.parquet(str(tmp_path / "t/2024/b"))
    got = {(r.k, r.v, r.w) for r in tables.read_parquet_tree(spark, str(tmp_path / "t")).collect()}
    assert got == {(1, "a", None), (2, "b", 1.5)}


TICKS = ddl("ts_utc TIMESTAMP, value DOUBLE, zone STRING, ingested_at STRING")


def deliver(spark, folder, rows, n):
    spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_streaming_upsert_over_two_deliveries(spark, tmp_path):
    folder = str(tmp_path)
    at = datetime(2024, 1, 31, 23)
    deliver(spark, folder, [(at, 1.0, "AT", "2024-02-01"), (at + timedelta(hours=2), 2.0, "AT", "2024-02-01")], 1)

    def run():
        stream = jobs.read_stream(spark, f"{folder}/in", TICKS)
        jobs.start_upsert(stream, f"{folder}/out", f"{folder}/cp", ["zone", "ts_utc"], "ingested_at", ["value"]).awaitTermination()

    run()
    deliver(spark, folder, [(at, 9.0, "AT", "2024-02-02"), (at + timedelta(hours=2), 0.5, "AT", "2024-01-01")], 2)
    run()
    run()
    got = {r.ts_utc: r.value for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {at: 9.0, at + timedelta(hours=2): 2.0}


def test_streaming_hourly_mean_and_dedup(spark, tmp_path):
    folder = str(tmp_path)
    at = datetime(2024, 1, 1, 5)
    rows = [(at + timedelta(minutes=15 * i), float(i), "AT", "x") for i in range(4)]
    deliver(spark, folder, rows, 1)
    deliver(spark, folder, rows, 2)
    stream = jobs.read_stream(spark, f"{folder}/in", TICKS)
    once = jobs.drop_refetched_stream(stream, ["ts_utc", "zone", "value"])
    q = once.writeStream.format("parquet").option("path", f"{folder}/d").option("checkpointLocation", f"{folder}/cpd").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{folder}/d").count() == 4
    seen = []
    hourly_mean = jobs.hourly_mean_stream(jobs.read_stream(spark, f"{folder}/d", TICKS), "value")
    q = (hourly_mean.writeStream.outputMode("complete").foreachBatch(lambda b, i: seen.append(b.collect()))
         .option("checkpointLocation", f"{folder}/cph").trigger(availableNow=True).start())
    q.awaitTermination()
    assert [(r.ts_utc, r.zone, r.value, r.n_subhours) for r in seen[-1]] == [(at, "AT", 1.5, 4)]


def test_hourly_means_are_upserted_and_old_hours_leave_the_state(spark, tmp_path):
    folder = str(tmp_path)
    at = datetime(2024, 1, 1, 5)
    stream = lambda: jobs.read_stream(spark, f"{folder}/in", TICKS)

    def run():
        q = jobs.start_hourly_means(stream(), "value", f"{folder}/out", f"{folder}/cp", watermark="2 days")
        q.awaitTermination()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        return states[-1]

    deliver(spark, folder, [(at + timedelta(hours=h), 1.0, "AT", "x") for h in range(48)], 1)
    first = run()
    deliver(spark, folder, [(at + timedelta(hours=47, minutes=15), 4.0, "AT", "x"), (at + timedelta(days=9), 7.0, "AT", "x")], 2)
    run()
    # Later than the watermark: the hour has left the state, and its published mean stays.
    deliver(spark, folder, [(at, 99.0, "AT", "x"), (at + timedelta(days=9, minutes=30), 9.0, "AT", "x")], 3)
    last = run()
    got = {r.ts_utc: (r.value, r.n_subhours) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert first >= 48 and last <= 2
    assert len(got) == 49
    assert got[at] == (1.0, 1) and got[at + timedelta(hours=47)] == (2.5, 2) and got[at + timedelta(days=9)] == (8.0, 2)


def test_session_must_be_utc(spark):
    require_utc(spark)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Vienna")
    try:
        with pytest.raises(ValueError, match="must be UTC"):
            require_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert build_session("again").sparkContext.applicationId == spark.sparkContext.applicationId
