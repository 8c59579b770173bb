"""Writers: each query writes to the scratch folder and reads the result back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.config import STRATEGY_DIM
from wattlake.plans import strategies
from wattlake.queries.feeds import Feeds
from wattlake.queries.oracle import checksum_sql
from wattlake.queries.registry import query
from wattlake.queries.windows import NUMBERS, numbers
from wattlake.session import scratch_dir
from wattlake.sources import sinks, snapshots
from wattlake.sources.schemas import EXPORTS, MARTS


@query("k01_monthly_partitions", """
    SELECT year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2""")
def _(t: Feeds) -> DataFrame:
    path = f"{scratch_dir(t.spark)}/months"
    rows = t.lineitem.select("l_orderkey", "l_shipdate", "l_quantity")
    snapshots.replace_months(rows, path, "l_shipdate")
    snapshots.replace_months(rows, path, "l_shipdate")  # a repeated run leaves the same rows
    return snapshots.read_months(t.spark, path).groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("k02_result_parquet", "SELECT * FROM annual", "volume_mwh:4 cost_eur:2 unit_cost_eur_mwh delta_vs_min_eur:2")
def _(t: Feeds) -> DataFrame:
    path = f"{scratch_dir(t.spark)}/annual"
    strategies.annual_summary(t.costs).write.parquet(path)
    return t.spark.read.parquet(path)


def export_input(t: Feeds, name: str) -> DataFrame:
    """What one export holds, built only when asked for."""

    def labels() -> DataFrame:
        return t.spark.createDataFrame(
            [(s, n, f"Strategy {s}", i, "#333333", d) for i, (s, n, d) in enumerate(STRATEGY_DIM, start=1)],
            "strategy_id string, strategy_name string, strategy_label string, sort_order int, color_hex string, description string")

    def provenance() -> DataFrame:
        last = t.monthly.where("price_base_eur_mwh is not null").agg(
            F.max(F.make_date("year_local", "month_local", F.lit(1))).alias("m"))
        return last.select(F.lit(False).alias("is_fixture"), F.date_format("m", "yyyy-MM").alias("data_last_month"),
                           F.lit("2002-01-01").alias("generated_on"))

    return {
        "price_daily": lambda: t.daily.where("price_base_eur_mwh is not null"), "price_monthly": lambda: t.monthly,
        "generation_monthly": lambda: t.generation, "procurement_cost_monthly": lambda: t.costs,
        "strategy_annual_summary": lambda: strategies.annual_summary(t.costs), "forward_risk_summary": lambda: t.risk_summary,
        "spread_monthly": lambda: t.spread, "dim_strategy": labels, "data_quality_monthly": lambda: t.dq,
        "forward_paths": lambda: t.path_costs, "ssot": lambda: numbers(t), "provenance": provenance,
    }[name]()


@query("k03_csv_exports", f"""
    SELECT 'price_daily' AS export, count(*) AS n_rows, 10 AS n_columns FROM daily WHERE price_base_eur_mwh IS NOT NULL
    UNION ALL SELECT 'price_monthly', count(*), 8 FROM monthly UNION ALL SELECT 'generation_monthly', count(*), 6 FROM generation
    UNION ALL SELECT 'procurement_cost_monthly', count(*), 6 FROM costs UNION ALL SELECT 'strategy_annual_summary', count(*), 7 FROM annual
    UNION ALL SELECT 'forward_risk_summary', count(*), 8 FROM risksum UNION ALL SELECT 'spread_monthly', count(*), 4 FROM spreadmonthly
    UNION ALL SELECT 'dim_strategy', count(*), 6 FROM dimstrategy UNION ALL SELECT 'data_quality_monthly', count(*), 14 FROM dq
    UNION ALL SELECT 'forward_paths', count(*), 4 FROM pathcosts UNION ALL SELECT 'ssot', count(*), 5 FROM ({NUMBERS})
    UNION ALL SELECT 'provenance', 1, 3""")
def _(t: Feeds) -> DataFrame:
    """All twelve exports written as CSV and counted from the written files."""
    folder = scratch_dir(t.spark)
    out = None
    for name in EXPORTS:
        sinks.write_export(export_input(t, name), name, f"{folder}/{name}")
        written = t.spark.read.option("header", "true").csv(f"{folder}/{name}")
        if tuple(written.columns) != EXPORTS[name][0]:
            raise ValueError(f"{name}: header {written.columns}")
        row = written.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("export"), "n_rows", F.lit(len(written.columns)).alias("n_columns"))
        out = row if out is None else out.unionByName(row)
    return out


#: Export -> (what it holds in the oracle, floating columns and their digits).
EXPORT_ROWS = {
    "price_daily": ("daily WHERE price_base_eur_mwh IS NOT NULL", ""),
    "price_monthly": ("monthly", ""),
    "generation_monthly": ("generation", ""),
    "procurement_cost_monthly": ("costs", "volume_mwh:4 cost_eur:2 unit_cost_eur_mwh"),
    "strategy_annual_summary": ("annual", "volume_mwh:4 cost_eur:2 unit_cost_eur_mwh delta_vs_min_eur:2"),
    "forward_risk_summary": ("risksum", "mean:2 std:2 p5:2 p50:2 p95:2 cvar95:2"),
    "spread_monthly": ("spreadmonthly", "spread_mean_eur_mwh share_at_above_de_pct"),
    "dim_strategy": (
        "(SELECT *, 'Strategy ' || strategy_id AS strategy_label, '#333333' AS color_hex FROM dimstrategy)", "",
    ),
    "data_quality_monthly": ("dq", "coverage_at_pct"),
    "forward_paths": ("pathcosts", "cost_eur:2"),
    "ssot": (f"({NUMBERS})", ""),
    "provenance": (
        "(SELECT false AS is_fixture, strftime(last_month, '%Y-%m') AS data_last_month, '2002-01-01' AS generated_on FROM lastmonth)", "",
    ),
}


def _export_content(name: str) -> None:
    rows, given = EXPORT_ROWS[name]
    columns = EXPORTS[name][0]
    mart = next((m for m in MARTS.values() if tuple(m.names) == columns), None)
    doubles = given or " ".join(f.name for f in mart.fields if f.dataType.simpleString() == "double") if mart else given

    @query(f"k03_export_{name}", f"SELECT {', '.join(columns)} FROM {rows}", doubles)
    def _(t: Feeds) -> DataFrame:
        """Every row of one export, read back from the written CSV."""
        path = f"{scratch_dir(t.spark)}/{name}"
        frame = export_input(t, name)
        sinks.write_export(frame, name, path)
        return t.spark.read.schema(frame.select(*columns).schema).option("header", "true").csv(path)


for _name in EXPORT_ROWS:
    _export_content(_name)


@query("k04_export_manifest", f"""
    SELECT 'data_quality_monthly' AS table_name, count(*) AS n_rows, {checksum_sql("d")} AS checksum FROM (
        SELECT md5(concat_ws(chr(31), year_local, month_local, expected_hours, priced_hours_at, priced_hours_delu, load_hours, weather_days,
                             days_in_month, coverage_at_pct::VARCHAR, n_dst_days, n_hours_from_pt15m, resolution, n_negative_hours, has_oespi::VARCHAR)) AS d FROM dq)
    UNION ALL SELECT 'dim_strategy', count(*), {checksum_sql("d")} FROM (
        SELECT md5(concat_ws(chr(31), strategy_id, strategy_name, 'Strategy ' || strategy_id, sort_order, '#333333', description)) AS d FROM dimstrategy)
    UNION ALL SELECT 'ssot', count(*), {checksum_sql("d")} FROM (
        SELECT md5(concat_ws(chr(31), key, value, unit, tag, produced_by)) AS d FROM ({NUMBERS}))
    UNION ALL SELECT 'provenance', count(*), {checksum_sql("d")} FROM (
        SELECT md5(concat_ws(chr(31), 'false', strftime(last_month, '%Y-%m'), '2002-01-01')) AS d FROM lastmonth)""")
def _(t: Feeds) -> DataFrame:
    names = ("data_quality_monthly", "dim_strategy", "ssot", "provenance")
    return sinks.export_manifest({n: export_input(t, n) for n in names})


@query("k06_numbers_by_producer", f"""
    SELECT produced_by AS producer, count(*) AS n, count(DISTINCT tag) AS tags FROM ({NUMBERS}) GROUP BY 1""")
def _(t: Feeds) -> DataFrame:
    path = f"{scratch_dir(t.spark)}/numbers"
    rows = numbers(t)
    sinks.write_numbers(rows, path)
    sinks.write_numbers(rows.where("produced_by = 'consumer/profile'"), path)  # one producer again
    return t.spark.read.parquet(path).groupBy("producer").agg(F.count("*").alias("n"), F.count_distinct("tag").alias("tags"))


@query("k02_mart_write_with_contract", "SELECT count(*) AS n_rows, count(price_base_eur_mwh) AS priced FROM monthly")
def _(t: Feeds) -> DataFrame:
    path = f"{scratch_dir(t.spark)}/fct_price_monthly"
    sinks.write_mart(t.monthly, "fct_price_monthly", path)
    back = t.spark.read.schema(MARTS["fct_price_monthly"]).parquet(path)
    return back.agg(F.count("*").alias("n_rows"), F.count("price_base_eur_mwh").alias("priced"))
