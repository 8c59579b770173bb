"""Table contracts: raw inputs, marts and exports. Column order is part of each."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "TIMESTAMP": T.TimestampType(), "DATE": T.DateType(), "DOUBLE": T.DoubleType(), "INT": T.IntegerType(),
    "BIGINT": T.LongType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(),
}


def ddl(text: str) -> T.StructType:
    """Struct type of ``name TYPE`` pairs; unlike ``fromDDL`` it needs no running session."""
    pairs = [item.split() for item in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


PROVENANCE = "ingested_at_utc STRING, source STRING, request_hash STRING"

RAW = {
    "entsoe_prices_at": ddl(f"ts_utc TIMESTAMP, price_eur_mwh DOUBLE, resolution STRING, zone STRING, {PROVENANCE}"),
    "entsoe_prices_delu": ddl(f"ts_utc TIMESTAMP, price_eur_mwh DOUBLE, resolution STRING, zone STRING, {PROVENANCE}"),
    "entsoe_load_at": ddl(f"ts_utc TIMESTAMP, load_mw DOUBLE, resolution STRING, zone STRING, {PROVENANCE}"),
    "entsoe_gen_at": ddl(
        "ts_utc TIMESTAMP, psr_type STRING, psr_name STRING, kind STRING, value_mw DOUBLE, "
        f"resolution STRING, zone STRING, {PROVENANCE}"
    ),
    "geosphere_graz_daily": ddl(
        f"date DATE, station_id STRING, tl_mittel_c DOUBLE, parameter_raw STRING, {PROVENANCE}"
    ),
}

INDEX_CSV_COLUMNS = ("month", "oespi_base", "oespi_peak", "source_url", "retrieved_at")

CALENDAR_COLUMNS = (
    "date_local DATE, year_local INT, month_local INT, hour_local INT, dow_local INT, "
    "is_weekend BOOLEAN, is_holiday_at BOOLEAN, is_peak_hour BOOLEAN, season STRING, "
    "hdd_18 DOUBLE, cdd_22 DOUBLE"
)

MARTS = {
    "dim_calendar": ddl(f"ts_utc TIMESTAMP, {CALENDAR_COLUMNS}"),
    "dim_strategy": ddl("strategy_id STRING, strategy_name STRING, description STRING"),
    "fct_price_hourly": ddl(
        "ts_utc TIMESTAMP, price_at_eur_mwh DOUBLE, price_delu_eur_mwh DOUBLE, "
        "spread_at_delu_eur_mwh DOUBLE, load_at_mw DOUBLE, is_negative_price BOOLEAN, "
        f"{CALENDAR_COLUMNS}"
    ),
    "fct_price_daily": ddl(
        "date_local DATE, price_base_eur_mwh DOUBLE, price_peak_eur_mwh DOUBLE, price_min DOUBLE, "
        "price_max DOUBLE, price_std DOUBLE, n_negative_hours BIGINT, tavg_c DOUBLE, hdd_18 DOUBLE, "
        "cdd_22 DOUBLE"
    ),
    "fct_price_monthly": ddl(
        "year_local INT, month_local INT, price_base_eur_mwh DOUBLE, price_peak_eur_mwh DOUBLE, "
        "price_offpeak_eur_mwh DOUBLE, n_negative_hours BIGINT, oespi_base DOUBLE, oespi_peak DOUBLE"
    ),
    "fct_generation_monthly": ddl(
        "year_local INT, month_local INT, psr_type STRING, psr_name STRING, gen_gwh DOUBLE, "
        "share_of_total DOUBLE"
    ),
    "fct_consumer_load_hourly": ddl("ts_utc TIMESTAMP, load_mwh DOUBLE"),
    "fct_procurement_cost_monthly": ddl(
        "year_local INT, month_local INT, strategy_id STRING, volume_mwh DOUBLE, cost_eur DOUBLE, "
        "unit_cost_eur_mwh DOUBLE"
    ),
    "fct_data_quality_monthly": ddl(
        "year_local INT, month_local INT, expected_hours BIGINT, priced_hours_at BIGINT, "
        "priced_hours_delu BIGINT, load_hours BIGINT, weather_days BIGINT, days_in_month BIGINT, "
        "coverage_at_pct DOUBLE, n_dst_days BIGINT, n_hours_from_pt15m BIGINT, resolution STRING, "
        "n_negative_hours BIGINT, has_oespi BOOLEAN"
    ),
}

#: Export name -> (column list, sort columns).
EXPORTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "price_daily": (tuple(MARTS["fct_price_daily"].names), ("date_local",)),
    "price_monthly": (tuple(MARTS["fct_price_monthly"].names), ("year_local", "month_local")),
    "generation_monthly": (
        tuple(MARTS["fct_generation_monthly"].names), ("year_local", "month_local", "psr_type"),
    ),
    "procurement_cost_monthly": (
        tuple(MARTS["fct_procurement_cost_monthly"].names), ("year_local", "month_local", "strategy_id"),
    ),
    "strategy_annual_summary": (
        ("year", "strategy_id", "volume_mwh", "cost_eur", "unit_cost_eur_mwh", "delta_vs_min_eur", "rank"),
        ("year", "strategy_id"),
    ),
    "forward_risk_summary": (
        ("variant", "strategy_id", "mean", "std", "p5", "p50", "p95", "cvar95"), ("variant", "strategy_id"),
    ),
    "spread_monthly": (
        ("year_local", "month_local", "spread_mean_eur_mwh", "share_at_above_de_pct"),
        ("year_local", "month_local"),
    ),
    "dim_strategy": (
        ("strategy_id", "strategy_name", "strategy_label", "sort_order", "color_hex", "description"),
        ("sort_order",),
    ),
    "data_quality_monthly": (
        tuple(MARTS["fct_data_quality_monthly"].names), ("year_local", "month_local"),
    ),
    "forward_paths": (("variant", "path", "strategy_id", "cost_eur"), ("variant", "strategy_id", "path")),
    "ssot": (("key", "value", "unit", "tag", "produced_by"), ("key",)),
    "provenance": (("is_fixture", "data_last_month", "generated_on"), ("data_last_month",)),
}

#: One ``TimeSeries`` of a market document; element names carry dots.
TIME_SERIES = (
    "STRUCT<mRID: STRING, businessType: STRING, curveType: STRING, "
    "`classificationSequence_AttributeInstanceComponent.position`: STRING, "
    "`currency_Unit.name`: STRING, `price_Measure_Unit.name`: STRING, "
    "`in_Domain.mRID`: STRUCT<_VALUE: STRING, _codingScheme: STRING>, "
    "`out_Domain.mRID`: STRUCT<_VALUE: STRING, _codingScheme: STRING>, "
    "`outBiddingZone_Domain.mRID`: STRUCT<_VALUE: STRING, _codingScheme: STRING>, "
    "MktPSRType: STRUCT<psrType: STRING>, "
    "Period: ARRAY<STRUCT<timeInterval: STRUCT<start: STRING, `end`: STRING>, resolution: STRING, "
    "Point: ARRAY<STRUCT<position: STRING, `price.amount`: STRING, quantity: STRING>>>>>"
)
#: Numbers are read as text and cast one by one, so a bad one is found and does not void its document.
CORRUPT = "_corrupt_document"
MARKET_DOCUMENT = f"TimeSeries ARRAY<{TIME_SERIES}>, Reason STRUCT<code: STRING, text: STRING>, {CORRUPT} STRING"

WEATHER_DOCUMENT = (
    "timestamps ARRAY<STRING>, features ARRAY<STRUCT<properties: STRUCT<parameters: "
    "STRUCT<tl_mittel: STRUCT<data: ARRAY<DOUBLE>>>>>>"
)
STATION_DOCUMENT = (
    "stations ARRAY<STRUCT<id: BIGINT, name: STRING, lat: DOUBLE, lon: DOUBLE, valid_from: STRING>>"
)
