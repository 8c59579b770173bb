"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores,
``BENCH_ALL=1`` times every registered query. Each result is written to the
``noop`` sink, so all rows and columns are computed and none reach the driver.
Each derived table is built and timed on its own (``mart_...``, their sum is
``marts_build``), so no query below pays for another's table or hides its own.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wattlake.queries import QUERIES  # noqa: E402
from wattlake.queries.feeds import close_feeds, feeds_for  # noqa: E402
from wattlake.queries.windows import numbers  # noqa: E402
from wattlake.session import build_session  # noqa: E402

HEADLINE = (
    "s07_market_document_flattening s08_curve_position_fill s13_weather_json_flattening s16_union_of_responses "
    "s19_calendar_spine w01_latest_wins_prices w01_latest_wins_lineitem a01_hourly_mean_of_subhours a01_hourly_prices "
    "a12_quantiles_of_unbounded_groups a28_annual_market_summary a29_spread_summary d02_fct_price_hourly "
    "d05_fct_generation_monthly d08_profile_yearly_normalisation d11_monthly_spot_per_market_segment "
    "d16_monthly_strategy_costs d17_annual_priority_cost_matrix d17_annual_summary d18_wrong_strategy_cost "
    "d19_sensitivity_matrix j12_transcription_reconcile j17_hour_alignment q02_unique_combination q10_duplicate_budget "
    "q13_hour_coverage q24_numbers_in_text q28_gate_report q29_data_quality_monthly r03_price_cells r06_path_costs "
    "r07_risk_metrics t02_z_score t03_volatility_regimes t04_garch_grid t05_ols_month_effects_hc1 m05_cumulative_cost "
    "k01_monthly_partitions st1_streaming_hourly_mean"
).split()
#: In the order of their dependencies.
MARTS = (
    "calendar", "prices", "hourly", "index", "daily", "monthly", "generation", "dq", "consumer_load", "spot", "scenarios",
    "scenario_costs", "labelled", "cells", "risk_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first job of a session pays for class loading, not for a query.
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    feeds = feeds_for(spark, sf_dir)
    for name in MARTS:
        start = time.perf_counter()
        getattr(feeds, name)
        times[f"mart_{name}"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    numbers(feeds)
    times["mart_numbers"] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    for name in QUERIES if os.environ.get("BENCH_ALL") else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    value = round(sum(times.values()), 3)
    times["marts_build"] = total
    close_feeds(spark)
    print(json.dumps({
        "metric": "headline_queries_total", "value": value, "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
