"""Streaming forms, driven to completion over the whole event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.queries.feeds import Feeds
from wattlake.queries.registry import query
from wattlake.session import scratch_dir
from wattlake.sources import snapshots
from wattlake.streaming import jobs


def event_stream(t: Feeds) -> DataFrame:
    """The event table as a file stream of ticks; event time becomes an instant."""
    schema = t.table("events").schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return raw.select(F.col("ts").cast("timestamp").alias("ts_utc"), F.col("event_type").alias("zone"), "value", "event_id")


@query("st1_streaming_hourly_mean", """
    SELECT date_trunc('hour', ts) AS ts_utc, event_type AS zone, avg(value) AS value, count(*) AS n_subhours FROM events GROUP BY 1, 2""", "value:7")
def _(t: Feeds) -> DataFrame:
    """The watermark spans the unordered test stream; each batch publishes the hours it changed."""
    folder = scratch_dir(t.spark)
    jobs.start_hourly_snapshots(event_stream(t), "value", f"{folder}/table", f"{folder}/cp", watermark="3650 days").awaitTermination()
    return jobs.hourly_snapshot(t.spark, f"{folder}/table").select("ts_utc", "zone", "value", "n_subhours")


@query("st2_restatement_upsert", """
    SELECT event_type AS zone, date_trunc('hour', ts) AS hour, max_by(value, event_id) AS value FROM events GROUP BY 1, 2""")
def _(t: Feeds) -> DataFrame:
    """Every event restates its hour; the last one ingested wins. Two passes change nothing."""
    folder = scratch_dir(t.spark)
    ingested = F.timestamp_seconds(F.col("event_id")).alias("ingested_at")
    rows = event_stream(t).select("zone", F.date_trunc("hour", "ts_utc").alias("ts_utc"), "value", ingested)
    for run in ("first", "again"):
        q = jobs.start_snapshot_upsert(rows, f"{folder}/table", f"{folder}/cp_{run}", ["zone", "ts_utc"], "ingested_at")
        q.awaitTermination()
    kept = snapshots.read_latest(t.spark, f"{folder}/table", ["zone", "ts_utc"], "ingested_at")
    return kept.select("zone", F.col("ts_utc").alias("hour"), "value")


@query("st3_refetch_deduplication", """
    WITH data AS (SELECT date_trunc('hour', ts) AS ts_utc, event_type AS zone, round(value) AS value, 1 AS response_no FROM events
        UNION ALL SELECT date_trunc('hour', ts), event_type, round(value) + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END, 2 FROM events)
    SELECT ts_utc, zone, value, response_no FROM (SELECT *, min(response_no) OVER (PARTITION BY ts_utc, zone, value) AS first FROM data)
    WHERE response_no = first""", "value:1")
def _(t: Feeds) -> DataFrame:
    """All rows delivered twice, every fifth one restated by the second response.

    Equal rows inside a response stay. A tick far ahead closes the open rows at the end, as the next delivery would.
    """
    folder = scratch_dir(t.spark)
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts_utc")
    restated = F.round("value") + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    told = lambda value, number: t.events.select(hour, F.col("event_type").alias("zone"), value.alias("value"), F.lit(number).alias("response_no"))
    ahead = t.events.agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).select(
        (F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts_utc"), F.lit("ahead").alias("zone"), F.lit(0.0).alias("value"), F.lit(3).alias("response_no"))
    rows = told(F.round("value"), 1).unionByName(told(restated, 2)).unionByName(ahead)
    rows.write.parquet(f"{folder}/in")
    stream = jobs.read_stream(t.spark, f"{folder}/in", rows.schema)
    kept = jobs.first_response_stream(stream, ["ts_utc", "zone", "value"], "response_no", watermark="45 days")
    q = (kept.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    q.awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").where("zone <> 'ahead'")
