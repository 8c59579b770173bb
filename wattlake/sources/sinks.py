"""Writers. Each is idempotent: running it again leaves the same files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.config import PROVENANCE_TAGS
from wattlake.functions.hashing import table_checksum
from wattlake.operators.checks import assert_contract
from wattlake.sources.schemas import EXPORTS, MARTS


def out_of_month(df: DataFrame, key: str, month: str) -> DataFrame:
    """Write-boundary gate: rows outside the target month (``YYYY-MM``)."""
    return df.where(F.date_format(F.col(key), "yyyy-MM") != month)


def write_months(df: DataFrame, path: str, key: str) -> None:
    """Replace exactly the month partitions present in ``df``.

    Dynamic overwrite leaves other months alone and the committer publishes a
    partition only when its tasks succeed. The rebalance hint lets adaptive
    execution split a heavy month over several writers and give many light
    months to one, by measured size.
    """
    (
        df.withColumn("year", F.year(key))
        .withColumn("month", F.month(key))
        .hint("rebalance", "year", "month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month")
        .parquet(path)
    )


def write_mart(df: DataFrame, name: str, path: str) -> None:
    """Write a mart after checking its contract."""
    assert_contract(df, MARTS[name]).write.mode("overwrite").parquet(path)


def export_frame(df: DataFrame, name: str) -> DataFrame:
    """Contract columns in contract order, sorted as the export promises."""
    columns, order = EXPORTS[name]
    return df.select(*columns).orderBy(*order)


def write_export(df: DataFrame, name: str, path: str) -> None:
    """Header CSV of an export.

    The global sort is a range partitioning, so the part files in name order
    are the sorted table; none of them passes through a single task.
    """
    export_frame(df, name).write.mode("overwrite").option("header", "true").csv(path)


def export_manifest(frames: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, n_rows, checksum`` per exported table."""
    out = None
    for name, frame in frames.items():
        row = table_checksum(frame.select(*EXPORTS[name][0]), name)
        out = row if out is None else out.unionByName(row)
    return out


def write_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None) -> None:
    """Create the table if missing, empty it otherwise, and load it whole."""
    df.write.option("truncate", "true").jdbc(url, table, mode="overwrite", properties=dict(properties or {}))


def numbers_table(rows: DataFrame) -> DataFrame:
    """Published numbers with an accepted tag; anything else is an error."""
    good = F.col("tag").isin(*PROVENANCE_TAGS)
    tag = F.when(good, F.col("tag")).otherwise(
        F.raise_error(F.concat(F.lit("unknown tag: "), F.coalesce("tag", F.lit("null")))).cast("string")
    )
    return rows.select("key", "value", "unit", tag.alias("tag"), "produced_by")


def write_numbers(rows: DataFrame, path: str) -> None:
    """Replace each producer's rows, leaving other producers untouched."""
    (
        numbers_table(rows)
        .withColumn("producer", F.col("produced_by"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("producer")
        .parquet(path)
    )
