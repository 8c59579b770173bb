"""Raw tables to hourly grain.

This is where the volume is: everything after it is bounded by
hours x series. Both steps are plain aggregations with map-side partials.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.operators.dedup import latest_wins


def native_prices(raw: DataFrame, zone: str | None = None) -> DataFrame:
    """Latest ingested price per (zone, instant).

    Ties on ingestion time go to the alphabetically first resolution, then to
    the lowest price, so the result never depends on row order. Of rows that
    differ in price alone only the lowest can win: they go in a hash
    aggregation, so the ordered one sorts one row per version and not every copy.
    """
    rows = raw if zone is None else raw.where(F.col("zone") == zone)
    versions = rows.groupBy("zone", "ts_utc", "resolution", "ingested_at_utc").agg(F.min("price_eur_mwh").alias("price_eur_mwh"))
    kept = latest_wins(versions, ["zone", "ts_utc"], "ingested_at_utc", ["resolution", "price_eur_mwh"])
    return kept.select("ts_utc", "price_eur_mwh", "resolution", "zone")


def hourly_mean(df: DataFrame, value: str, keys: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Mean per hour (never a sum), optionally with the number of source rows."""
    aggs = [F.avg(value).alias(value)]
    if count:
        aggs.append(F.count("*").alias(count))
    return df.groupBy(*keys, F.date_trunc("hour", "ts_utc").alias("ts_utc")).agg(*aggs)


def hourly_prices(raw: DataFrame, zone: str | None = None) -> DataFrame:
    """``zone, ts_utc, price_eur_mwh, n_subhours``."""
    return hourly_mean(native_prices(raw, zone), "price_eur_mwh", ["zone"], "n_subhours")


def hourly_load(raw: DataFrame) -> DataFrame:
    return hourly_mean(raw, "load_mw")


def hourly_generation(raw: DataFrame) -> DataFrame:
    """Mean production per hour and plant type; consumption rows are left out."""
    produced = raw.where(F.col("kind") == "aggregated")
    return hourly_mean(produced, "value_mw", ["psr_type", "psr_name"]).select(
        "ts_utc", "psr_type", "psr_name", F.col("value_mw").alias("gen_mw")
    )


def daily_weather(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("date").alias("date_local"), F.col("tl_mittel_c").alias("tavg_c"))
