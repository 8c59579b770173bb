"""Table readers with explicit schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlake.config import STRATEGY_DIM
from wattlake.sources.schemas import INDEX_CSV_COLUMNS, MARTS, RAW


class ContractError(ValueError):
    """Input data breaks its table contract."""


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """One parquet file or folder; pruning and filters reach the scan."""
    return spark.read.parquet(path)


def read_parquet_tree(spark: SparkSession, path: str) -> DataFrame:
    """All parquet files below ``path``, columns united by name (missing ones NULL)."""
    return (
        spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)
    )


def read_raw(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A raw time-series table against its contract; no file footers are merged."""
    return spark.read.schema(RAW[name]).option("recursiveFileLookup", "true").parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def query(spark: SparkSession, sql: str, views: Mapping[str, DataFrame], args: Mapping[str, object] | None = None) -> DataFrame:
    """Parameterised SQL over named frames, or over ``parquet.`path` `` directly."""
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(sql, args=dict(args or {}))


def strategy_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STRATEGY_DIM), MARTS["dim_strategy"])


def read_index_text(spark: SparkSession, path: str) -> DataFrame:
    """The monthly index file with every cell kept as text, header order enforced."""
    raw = spark.read.option("header", "true").option("inferSchema", "false").option(
        "nullValue", "\u0000").option("emptyValue", "").csv(path)
    if tuple(raw.columns) != INDEX_CSV_COLUMNS:
        raise ContractError(f"expected columns {list(INDEX_CSV_COLUMNS)}, found {raw.columns}")
    return raw


def index_violations(raw: DataFrame) -> DataFrame:
    """All contract counts of the index text table in a single pass."""
    base, peak = F.trim("oespi_base"), F.trim(F.coalesce("oespi_peak", F.lit("")))
    return raw.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("source_url").alias("n_sources"),
        F.count_if(F.coalesce(~F.col("month").rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.lit(True))).alias("bad_months"),
        F.count_if(base.try_cast("double").isNull()).alias("bad_base"),
        F.count_if(peak == "").alias("blank_peak"),
        F.count_if((peak != "") & peak.try_cast("double").isNull()).alias("bad_peak"),
    )


def load_index(raw: DataFrame) -> tuple[DataFrame, bool]:
    """Typed monthly index ``(month_local, oespi_base, oespi_peak)`` and whether peak exists.

    Bad cells raise; none becomes a silent NULL. The peak column must be all
    present or all blank.
    """
    v = index_violations(raw).first()
    if v.n_rows == 0:
        raise ContractError("index table has no rows")
    if v.n_sources != 1:
        raise ContractError(f"index table mixes {v.n_sources} sources")
    if v.bad_months or v.bad_base:
        raise ContractError(f"{v.bad_months} bad month(s), {v.bad_base} bad base value(s)")
    if v.blank_peak not in (0, v.n_rows):
        raise ContractError(f"peak blank for {v.blank_peak} of {v.n_rows} months")
    if v.bad_peak:
        raise ContractError(f"{v.bad_peak} bad peak value(s)")
    typed = raw.select(
        F.to_date("month", "yyyy-MM").alias("month_local"),
        F.trim("oespi_base").try_cast("double").alias("oespi_base"),
        F.trim("oespi_peak").try_cast("double").alias("oespi_peak"),
    )
    return typed, v.blank_peak == 0


def index_pass_through(raw: DataFrame) -> DataFrame:
    """Typed index rows without the contract gate (staging view)."""
    return raw.select(
        F.to_date("month", "yyyy-MM").alias("month_local"), "oespi_base", "oespi_peak"
    )


def with_provenance(df: DataFrame, dataset: str, ingested_at: str | None = None, request_hash_of: Sequence[str] = ()) -> DataFrame:
    """Append ``ingested_at_utc, source, request_hash`` as the last columns."""
    now = F.lit(ingested_at) if ingested_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    digest = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in request_hash_of]), 256)
    return df.select(
        "*",
        now.alias("ingested_at_utc"),
        F.split_part(F.lit(dataset), F.lit("_"), F.lit(1)).alias("source"),
        digest.alias("request_hash"),
    )
