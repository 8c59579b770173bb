"""Month tables with snapshots: a restatement becomes visible as a whole or not at all.

A table is a folder with ``data/version=<n>-<id>/year=/month=`` and ``manifests/<n>.json``. A writer puts its months
under a new version and then publishes one small manifest, which names the versions that make up each month.
The manifest is written under another name and renamed to its number, which fails if that number exists. So a
reader sees the months of one manifest, a writer that dies between two months leaves only files that
nobody reads, and of two writers at once the second gets an error instead of undoing the first.

A batch may also be appended: its rows lie beside those of the month until the month is compacted, and a reader
takes the latest row of each key. What a batch writes then grows with the batch, not with the months it touches.

A manifest has one entry per month, so the driver's part is bounded by the calendar.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from wattlake.operators.dedup import latest_wins

#: Versions of a month before it is compacted.
MOST_PARTS = 8


class ConcurrentWrite(RuntimeError):
    """Another writer published the version this one was based on."""


@dataclass(frozen=True)
class Manifest:
    """What a snapshot holds: the versions of each month, oldest first, and the columns."""

    number: int = 0
    schema: str = ""
    months: dict[str, list[str]] = field(default_factory=dict)


def _path(spark: SparkSession, path: str):  # noqa: ANN202 - a JVM file system and path
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, path = _path(spark, folder)
    return [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []


def current(spark: SparkSession, path: str) -> Manifest:
    """The last published manifest; number 0 and no months for a table not yet written."""
    numbers = [int(name[:-5]) for name in _names(spark, f"{path}/manifests") if re.fullmatch(r"\d+\.json", name)]
    if not numbers:
        return Manifest()
    number = max(numbers)
    text = spark.read.text(f"{path}/manifests/{number:09d}.json", wholetext=True).first()[0]
    return Manifest(number, **json.loads(text))


def _publish(spark: SparkSession, path: str, manifest: Manifest) -> None:
    body = json.dumps({"schema": manifest.schema, "months": manifest.months}, sort_keys=True)
    files, hidden = _path(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    _, target = _path(spark, f"{path}/manifests/{manifest.number:09d}.json")
    out = files.create(hidden, False)
    out.write(bytearray(body.encode()))
    out.close()
    if files.exists(target) or not files.rename(hidden, target):
        files.delete(hidden, False)
        raise ConcurrentWrite(f"{path}: version {manifest.number} exists")


def _write(df: DataFrame, path: str, key: str, base: Manifest) -> tuple[str, list[str]]:
    """Rows under a new version; returns its name and the months it has. Nothing is visible yet."""
    version = f"{base.number + 1:09d}-{uuid.uuid4().hex[:12]}"
    folder = f"{path}/data/version={version}"
    (
        df.withColumn("year", F.year(key)).withColumn("month", F.month(key))
        .hint("rebalance", "year", "month").write.partitionBy("year", "month").parquet(folder)
    )
    spark = df.sparkSession
    years = [n for n in _names(spark, folder) if n.startswith("year=")]
    return version, [f"{year}/{m}" for year in years for m in _names(spark, f"{folder}/{year}") if m.startswith("month=")]


def _schema(df: DataFrame, base: Manifest) -> str:
    if base.schema and StructType.fromJson(json.loads(base.schema)).names != df.columns:
        raise ValueError(f"columns {df.columns} differ from those of the table")
    return base.schema or df.schema.json()


def replace_months(df: DataFrame, path: str, key: str) -> Manifest:
    """Publish a snapshot in which exactly the months present in ``df`` are replaced by its rows."""
    base = current(df.sparkSession, path)
    version, months = _write(df, path, key, base)
    made = Manifest(base.number + 1, _schema(df, base), {**base.months, **{m: [version] for m in months}})
    _publish(df.sparkSession, path, made)
    return made


def append_rows(df: DataFrame, path: str, key: str) -> Manifest:
    """Publish a snapshot that holds the rows of ``df`` beside those already there."""
    base = current(df.sparkSession, path)
    version, months = _write(df, path, key, base)
    added = {m: [*base.months.get(m, []), version] for m in months}
    made = Manifest(base.number + 1, _schema(df, base), {**base.months, **added})
    _publish(df.sparkSession, path, made)
    return made


def read_months(spark: SparkSession, path: str, manifest: Manifest | None = None, months: Sequence[str] | None = None) -> DataFrame:
    """The rows of a snapshot, by default of the last one, with ``year`` and ``month``; ``months`` narrows it down."""
    held = manifest or current(spark, path)
    if not held.schema:
        raise ValueError(f"{path} has no snapshot")
    columns = StructType.fromJson(json.loads(held.schema))
    folders = [f"{path}/data/version={v}/{m}" for m, versions in held.months.items() if months is None or m in months for v in versions]
    if not folders:
        return spark.createDataFrame([], columns).withColumns({"year": F.lit(0), "month": F.lit(0)}).limit(0)
    rows = spark.read.schema(columns).option("basePath", f"{path}/data")
    full = StructType.fromJson(json.loads(held.schema)).add("year", IntegerType()).add("month", IntegerType())
    return rows.schema(full).parquet(*folders).select(*columns.names, "year", "month")


def read_latest(
    spark: SparkSession, path: str, keys: Sequence[str], ingested_at: str, tie_break: Sequence[str] = (), months: Sequence[str] | None = None,
    manifest: Manifest | None = None,
) -> DataFrame:
    """The latest row of each key of a snapshot that batches were appended to."""
    return latest_wins(read_months(spark, path, manifest, months), [*keys, "year", "month"], ingested_at, tie_break)


def compact(
    spark: SparkSession, path: str, key: str, keys: Sequence[str], ingested_at: str, tie_break: Sequence[str] = (), most: int = MOST_PARTS
) -> Manifest:
    """Rewrite the months of over ``most`` versions as one, keeping the latest row of each key."""
    base = current(spark, path)
    due = [m for m, versions in base.months.items() if len(versions) > most]
    if not due:
        return base
    kept = read_latest(spark, path, keys, ingested_at, tie_break, due, base).drop("year", "month")
    version, months = _write(kept, path, key, base)
    made = Manifest(base.number + 1, base.schema, {**base.months, **{m: [version] for m in months}})
    _publish(spark, path, made)
    return made
