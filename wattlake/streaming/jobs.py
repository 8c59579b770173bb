"""Streaming jobs: hourly means, latest-wins upsert, refetch deduplication.

Streams carry event time in ``ts_utc`` (an instant, not a wall-clock type).
The watermark equals the restatement lookback. The hourly means run in update
mode: a batch emits the hours it changed, a keyed upsert puts them into the
month tables, and hours older than the watermark leave the state, which is
therefore bounded by 45 days x zones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wattlake.config import LOOKBACK_DAYS
from wattlake.operators.dedup import latest_wins
from wattlake.sources import snapshots
from wattlake.sources.sinks import write_months

WATERMARK = f"{LOOKBACK_DAYS} days"


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly_mean_stream(ticks: DataFrame, value: str, key: str = "zone", watermark: str = WATERMARK) -> DataFrame:
    """Tumbling one-hour mean and source-row count per key; keeps two numbers per open hour."""
    windowed = ticks.withWatermark("ts_utc", watermark).groupBy(F.window("ts_utc", "1 hour"), key)
    return windowed.agg(F.avg(value).alias(value), F.count("*").alias("n_subhours")).select(
        F.col("window.start").alias("ts_utc"), key, value, "n_subhours"
    )


def drop_refetched_stream(rows: DataFrame, data_cols: Sequence[str], watermark: str = WATERMARK) -> DataFrame:
    """Drop rows already delivered with identical data inside the watermark."""
    return rows.withWatermark("ts_utc", watermark).dropDuplicatesWithinWatermark(list(data_cols))


def upsert_latest(path: str, keys: Sequence[str], ingested_at: str, tie_break: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: merge a batch into month partitions, latest ingestion wins.

    Only partitions the batch touches are read and rewritten. The merged rows
    are checkpointed before the overwrite, since the files being replaced are
    also an input. Replaying a batch writes the same rows.
    """
    from wattlake.session import cut_lineage

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = batch.columns
        months = batch.select(F.year("ts_utc").alias("year"), F.month("ts_utc").alias("month")).distinct()
        merged = batch
        if _has_data(spark, path):
            stored = spark.read.parquet(path)
            touched = stored.join(F.broadcast(months), ["year", "month"], "left_semi")
            merged = touched.select(*columns).unionByName(batch)
        kept = cut_lineage(latest_wins(merged, keys, ingested_at, tie_break))
        write_months(kept, path, "ts_utc")

    return run


def start_hourly_means(
    ticks: DataFrame, value: str, path: str, checkpoint: str, key: str = "zone", watermark: str = WATERMARK
) -> StreamingQuery:
    """Keeps the table ``ts_utc, key, value, n_subhours, batch_id`` at ``path`` up to date.

    An hour that changes again is emitted again with its new mean; the batch
    number tells which version is the latest, so replaying a batch changes nothing.
    """
    upsert = upsert_latest(path, [key, "ts_utc"], "updated_at", ())

    def publish(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("updated_at", F.timestamp_seconds(F.lit(batch_id)))
        upsert(stamped, batch_id)

    return (
        hourly_mean_stream(ticks, value, key, watermark)
        .writeStream.outputMode("update").foreachBatch(publish)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def append_latest(path: str, keys: Sequence[str], ingested_at: str, tie_break: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: publish a snapshot with the batch's latest rows beside the table, compact months of many parts.

    It writes what changed, not the months touched. A replayed batch adds rows that lose or equal those there, and readers of
    ``snapshots.read_latest`` see whole batches only.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        snapshots.append_rows(latest_wins(batch, keys, ingested_at, tie_break), path, "ts_utc")
        snapshots.compact(batch.sparkSession, path, "ts_utc", keys, ingested_at, tie_break)

    return run


def start_hourly_snapshots(
    ticks: DataFrame, value: str, path: str, checkpoint: str, key: str = "zone", watermark: str = WATERMARK
) -> StreamingQuery:
    """``start_hourly_means`` into a table with snapshots, read by ``hourly_snapshot``."""
    publish = append_latest(path, [key, "ts_utc"], "updated_at", ())

    def run(batch: DataFrame, batch_id: int) -> None:
        publish(batch.withColumn("updated_at", F.timestamp_seconds(F.lit(batch_id))), batch_id)

    means = hourly_mean_stream(ticks, value, key, watermark)
    return means.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_snapshot(spark: SparkSession, path: str, key: str = "zone") -> DataFrame:
    """The published hourly means, one row per hour."""
    return snapshots.read_latest(spark, path, [key, "ts_utc"], "updated_at").drop("updated_at", "year", "month")


def start_snapshot_upsert(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], ingested_at: str, tie_break: Sequence[str] = ()
) -> StreamingQuery:
    """``start_upsert`` into a table with snapshots, read by ``snapshots.read_latest``."""
    return (
        stream.writeStream.foreachBatch(append_latest(path, keys, ingested_at, tie_break))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_response_stream(rows: DataFrame, data_cols: Sequence[str], response: str, watermark: str = WATERMARK) -> DataFrame:
    """Rows of the response that delivered their data first: copies inside one response stay, later responses go.

    Two stateful steps under one watermark: the first response number per row of data is a streaming aggregation,
    and the rows are joined back to it. ``data_cols`` hold ``ts_utc``, so both states fall with the watermark; a row
    is emitted when its time has passed it.
    """
    timed = rows.withWatermark("ts_utc", watermark)
    first = timed.groupBy(*data_cols).agg(F.min(response).alias("_first"))
    other = [F.col(c).alias(f"_{c}") for c in data_cols if c != "ts_utc"]
    first = first.select("ts_utc", "_first", *other)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f._{c}")) for c in data_cols if c != "ts_utc"]
    matched = reduce(lambda a, b: a & b, same, (F.col("r.ts_utc") == F.col("f.ts_utc")) & (F.col(f"r.{response}") == F.col("f._first")))
    return timed.alias("r").join(first.alias("f"), matched).select(*[F.col(f"r.`{c}`") for c in rows.columns])


def _has_data(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def start_upsert(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], ingested_at: str, tie_break: Sequence[str] = ()
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(upsert_latest(path, keys, ingested_at, tie_break))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
