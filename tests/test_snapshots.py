"""Tables with snapshots and the streaming forms that use them."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattlake.sources import snapshots
from wattlake.streaming import jobs

TICKS = "ts_utc timestamp, value double, zone string, ingested_at string"


def rows_of(spark, months, value):
    rows = [(datetime(2024, m, d), value, "AT", f"2024-12-{int(value):02d}") for m in months for d in (1, 2, 3)]
    return spark.createDataFrame(rows, TICKS)


def held(spark, path):
    found = snapshots.read_months(spark, path).groupBy("month").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return {r.month: (r.n, r.s) for r in found.collect()}


def test_only_the_months_present_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.replace_months(rows_of(spark, (1, 2, 3), 1.0), path, "ts_utc")
    old = snapshots.current(spark, path)
    snapshots.replace_months(rows_of(spark, (2,), 5.0), path, "ts_utc")
    snapshots.replace_months(rows_of(spark, (2,), 5.0), path, "ts_utc")  # again: the same rows
    assert held(spark, path) == {1: (3, 3.0), 2: (3, 15.0), 3: (3, 3.0)}
    # A reader that began earlier still has its snapshot whole.
    assert snapshots.read_months(spark, path, old).agg(F.sum("value")).first()[0] == 9.0
    assert snapshots.read_months(spark, path).columns == ["ts_utc", "value", "zone", "ingested_at", "year", "month"]


def test_a_writer_that_dies_between_two_months_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    snapshots.replace_months(rows_of(spark, (1, 2), 1.0), path, "ts_utc")
    before = held(spark, path)
    # A task fails in the second month.
    dies = rows_of(spark, (1, 2), 9.0).withColumn(
        "value", F.when(F.month("ts_utc") == 2, F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="killed"):
        snapshots.replace_months(dies, path, "ts_utc")
    assert held(spark, path) == before

    # The driver dies after all files of one month, and some of the other, are in place.
    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "_publish", die)
        with pytest.raises(KeyboardInterrupt):
            snapshots.replace_months(rows_of(spark, (1, 2), 9.0), path, "ts_utc")
    assert held(spark, path) == before
    snapshots.replace_months(rows_of(spark, (1, 2), 4.0), path, "ts_utc")
    assert held(spark, path) == {1: (3, 12.0), 2: (3, 12.0)}


def test_of_two_writers_the_second_gets_an_error(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    snapshots.replace_months(rows_of(spark, (1,), 1.0), path, "ts_utc")
    stale = snapshots.current(spark, path)
    snapshots.replace_months(rows_of(spark, (2,), 2.0), path, "ts_utc")
    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "current", lambda *_: stale)
        with pytest.raises(snapshots.ConcurrentWrite):
            snapshots.replace_months(rows_of(spark, (1,), 3.0), path, "ts_utc")
    assert held(spark, path) == {1: (3, 3.0), 2: (3, 6.0)}


def test_appended_rows_win_by_ingestion_and_are_compacted(spark, tmp_path):
    path = str(tmp_path / "t")
    for value in (3.0, 7.0, 5.0):
        snapshots.append_rows(rows_of(spark, (1,), value), path, "ts_utc")
    snapshots.append_rows(rows_of(spark, (2,), 1.0), path, "ts_utc")
    latest = lambda: {r.ts_utc: r.value for r in snapshots.read_latest(spark, path, ["ts_utc"], "ingested_at").collect()}
    want = {datetime(2024, 1, d): 7.0 for d in (1, 2, 3)} | {datetime(2024, 2, d): 1.0 for d in (1, 2, 3)}
    assert latest() == want
    made = snapshots.compact(spark, path, "ts_utc", ["ts_utc"], "ingested_at", most=2)
    assert [len(v) for _, v in sorted(made.months.items())] == [1, 1]
    assert latest() == want and held(spark, path)[1] == (3, 21.0)


def test_empty_writes_and_other_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.read_months(spark, path)
    snapshots.replace_months(rows_of(spark, (), 1.0), path, "ts_utc")
    assert snapshots.read_months(spark, path).collect() == []
    with pytest.raises(ValueError, match="differ"):
        snapshots.replace_months(rows_of(spark, (1,), 1.0).drop("zone"), path, "ts_utc")


def deliver(spark, folder, rows, number):
    spark.createDataFrame(rows, TICKS).coalesce(1).write.parquet(f"{folder}/in/delivery={number}")


def test_streaming_upsert_into_snapshots(spark, tmp_path):
    folder, at = str(tmp_path), datetime(2024, 1, 31, 23)
    later = at + timedelta(hours=2)

    def run():
        stream = jobs.read_stream(spark, f"{folder}/in", TICKS)
        jobs.start_snapshot_upsert(stream, f"{folder}/out", f"{folder}/cp", ["zone", "ts_utc"], "ingested_at", ["value"]).awaitTermination()

    deliver(spark, folder, [(at, 1.0, "AT", "2024-02-01"), (later, 2.0, "AT", "2024-02-01")], 1)
    run()
    deliver(spark, folder, [(at, 9.0, "AT", "2024-02-02"), (later, 0.5, "AT", "2024-01-01")], 2)
    run()
    run()
    got = snapshots.read_latest(spark, f"{folder}/out", ["zone", "ts_utc"], "ingested_at", ["value"]).collect()
    assert {r.ts_utc: r.value for r in got} == {at: 9.0, later: 2.0}


def test_hourly_means_in_snapshots_are_the_last_ones(spark, tmp_path):
    folder, at = str(tmp_path), datetime(2024, 1, 1, 5)

    def run():
        stream = jobs.read_stream(spark, f"{folder}/in", TICKS)
        jobs.start_hourly_snapshots(stream, "value", f"{folder}/out", f"{folder}/cp", watermark="2 days").awaitTermination()

    deliver(spark, folder, [(at, 1.0, "AT", "x"), (at + timedelta(hours=1), 4.0, "AT", "x")], 1)
    run()
    deliver(spark, folder, [(at + timedelta(minutes=15), 2.0, "AT", "x")], 2)
    run()
    got = {r.ts_utc: (r.value, r.n_subhours) for r in jobs.hourly_snapshot(spark, f"{folder}/out").collect()}
    assert got == {at: (1.5, 2), at + timedelta(hours=1): (4.0, 1)}


def test_first_response_keeps_its_own_copies_and_its_state_falls(spark, tmp_path):
    folder, at = str(tmp_path), datetime(2024, 1, 1)
    schema = "ts_utc timestamp, zone string, value double, response_no int"
    rows = [(at, "AT", 1.0, 1), (at, "AT", 1.0, 1), (at, "AT", 1.0, 2), (at, "AT", 2.0, 2), (at, None, None, 2), (at, None, None, 3)]

    def run(new, number):
        spark.createDataFrame(new, schema).coalesce(1).write.parquet(f"{folder}/in/delivery={number}")
        kept = jobs.first_response_stream(jobs.read_stream(spark, f"{folder}/in", schema), ["ts_utc", "zone", "value"], "response_no", "10 days")
        q = (kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress[-1:])

    open_rows = run(rows[:3], 1)
    run(rows[3:], 2)  # the refetch comes in a later batch
    closed = run([(at + timedelta(days=40), "AT", 0.0, 4)], 3)
    got = sorted((r.zone or "", r.value or 0.0, r.response_no) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [("", 0.0, 2), ("AT", 1.0, 1), ("AT", 1.0, 1), ("AT", 2.0, 2)]
    assert open_rows >= 3 and closed <= 2
