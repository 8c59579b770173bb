"""The package's input tables, derived by Spark from the given test tables.

``orders`` plays the AT price feed, ``lineitem`` the DE-LU feed, load,
generation and the monthly index, ``customer`` the bootstrap paths. All of it
is projection and aggregation, so the inputs grow with the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlake.config import FLAT_PROFILE, FORWARD_CALENDAR_MONTHS, MAIN_PROFILE, PLANT_TYPE_NAMES, StrategyConfig
from wattlake.functions.exprs import avg_if, code_name
from wattlake.operators import spine, stats
from wattlake.plans import analytics, marts, profile, risk, staging, strategies
from wattlake.session import scratch_dir

#: The strategy window inside the history of the test tables.
TEST_CONFIG = StrategyConfig(years=(1996, 1997, 1998, 1999, 2000), reference_year=1995)


def _hours(n: Column) -> Column:
    return F.make_dt_interval(hours=n.cast("int"))


def _days(n: Column) -> Column:
    return F.make_dt_interval(days=n.cast("int"))


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


class mart(cached_property):
    """A derived table written once per session and read back, as a warehouse does.

    Only grains bounded by calendar x series or by configuration are kept this
    way, and the totals of the simulated paths, never raw rows. The files sit in the shared scratch folder, so they
    survive lost executors, cut the plan, and carry real sizes: Spark then
    picks broadcast joins from measured bytes instead of estimates.
    """

    def __init__(self, build: Callable[[Feeds], DataFrame]) -> None:
        super().__init__(lambda feeds: feeds.write_table(build.__name__, build(feeds)))
        self.__doc__ = build.__doc__


class Feeds:
    """Lazy access to base tables, raw feeds and derived facts."""

    cfg = TEST_CONFIG

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        # Hours are truncated in the session zone, so it is pinned here as well.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.scratch = scratch_dir(spark)
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def kept(self, name: str, build: Callable[[Feeds], DataFrame]) -> DataFrame:
        """A derived table that another module builds, written once like a ``mart``."""
        if name not in self._kept:
            self._kept[name] = self.write_table(name, build(self))
        return self._kept[name]

    def write_table(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.scratch}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    # ---- raw feeds ---------------------------------------------------------
    @cached_property
    def raw_at(self) -> DataFrame:
        """Hourly quotes, quarter-hourly from 2000 on; re-ingested copies occur."""
        fine = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp")
        quarters = F.when(fine, F.array(*[F.lit(q) for q in range(4)])).otherwise(F.array(F.lit(0)))
        rows = self.orders.select("*", F.explode(quarters).alias("q"))
        return rows.select(
            (F.col("o_orderdate") + _hours((F.col("o_orderkey") * 7) % 24)
             + F.make_dt_interval(mins=F.col("q") * 15)).alias("ts_utc"),
            ((F.col("o_totalprice") - 60000.0) / 2477.0 + F.col("q") * 0.37).alias("price_eur_mwh"),
            F.when(fine, "PT15M").otherwise("PT60M").alias("resolution"),
            F.lit("AT").alias("zone"),
            _iso(F.col("o_orderdate") + _days(F.col("o_custkey") % 30 + 1)).alias("ingested_at_utc"),
        )

    @cached_property
    def raw_delu(self) -> DataFrame:
        return self.lineitem.select(
            (F.col("l_shipdate") + _hours((F.col("l_orderkey") * 5 + F.col("l_linenumber") * 13) % 24)).alias("ts_utc"),
            ((F.col("l_extendedprice") - 12000.0) / 523.0).alias("price_eur_mwh"),
            F.lit("PT60M").alias("resolution"),
            F.lit("DE_LU").alias("zone"),
            _iso(F.col("l_shipdate") + _days(F.col("l_partkey") % 30 + 1)).alias("ingested_at_utc"),
        )

    @cached_property
    def raw_prices(self) -> DataFrame:
        return self.raw_at.unionByName(self.raw_delu)

    @cached_property
    def raw_load(self) -> DataFrame:
        quarter = (F.col("l_orderkey") * 11 + F.col("l_suppkey")) % 96
        return self.lineitem.select(
            (F.col("l_shipdate") + F.make_dt_interval(mins=(quarter * 15).cast("int"))).alias("ts_utc"),
            (F.lit(3000.0) + F.col("l_quantity") * 181.3 + F.col("l_discount") * 1000.0).alias("load_mw"),
            F.lit("PT15M").alias("resolution"), F.lit("AT").alias("zone"),
        )

    @cached_property
    def raw_gen(self) -> DataFrame:
        number = F.col("l_partkey") % 24 + 1
        code = F.concat(F.lit("B"), F.lpad(number.cast("string"), 2, "0"))
        return self.lineitem.select(
            (F.col("l_shipdate") + _hours((F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 24)).alias("ts_utc"),
            code.alias("psr_type"), code_name(code, PLANT_TYPE_NAMES).alias("psr_name"),
            F.when((number == 10) & (F.col("l_linestatus") == "O"), "consumption").otherwise("aggregated").alias("kind"),
            (F.col("l_extendedprice") / 97.0).alias("value_mw"),
            F.lit("PT60M").alias("resolution"), F.lit("AT").alias("zone"),
        )

    @cached_property
    def raw_weather(self) -> DataFrame:
        day = F.to_date("o_orderdate")
        daily = self.orders.groupBy(day.alias("date")).agg(F.avg("o_totalprice").alias("m"))
        season = F.cos(F.lit(2.0) * F.pi() * (F.dayofyear("date") - 15) / F.lit(365.0))
        temp = F.lit(10.0) - F.lit(12.0) * season + (F.col("m") - 250000.0) / 40000.0
        return daily.select("date", F.lit("30").alias("station_id"), (F.round(temp, 1) + F.lit(0.0)).alias("tl_mittel_c"))

    @mart
    def index(self) -> DataFrame:
        """Monthly index: ``month_local, oespi_base, oespi_peak``."""
        month = F.to_date(F.trunc("l_shipdate", "MM"))
        flag, price = F.col("l_returnflag"), F.col("l_extendedprice")
        monthly = self.lineitem.groupBy(month.alias("month_local")).agg(
            avg_if(flag == "R", price).alias("r"), avg_if(flag == "N", price).alias("n"), F.avg(price).alias("a")
        )
        return monthly.select(
            "month_local", (F.coalesce("r", "a") / 521.0).alias("oespi_base"),
            (F.coalesce("n", "a") / 617.0).alias("oespi_peak"),
        )

    # ---- staging and marts -------------------------------------------------
    @cached_property
    def bounds(self) -> DataFrame:
        return spine.calendar_bounds(self.orders, F.col("o_orderdate"), FORWARD_CALENDAR_MONTHS)

    @cached_property
    def spine(self) -> DataFrame:
        return spine.calendar_spine(self.bounds)

    @cached_property
    def weather(self) -> DataFrame:
        return staging.daily_weather(self.raw_weather)

    @mart
    def calendar(self) -> DataFrame:
        return marts.dim_calendar(self.spine, self.weather)

    @mart
    def prices(self) -> DataFrame:
        return staging.hourly_prices(self.raw_prices)

    @cached_property
    def load(self) -> DataFrame:
        return staging.hourly_load(self.raw_load)

    @mart
    def hourly(self) -> DataFrame:
        return marts.fct_price_hourly(self.calendar, self.prices, self.load)

    @mart
    def daily(self) -> DataFrame:
        return marts.fct_price_daily(self.hourly, self.weather)

    @mart
    def monthly(self) -> DataFrame:
        return marts.fct_price_monthly(self.hourly, self.index)

    @mart
    def generation(self) -> DataFrame:
        return marts.fct_generation_monthly(staging.hourly_generation(self.raw_gen), self.calendar)

    @mart
    def dq(self) -> DataFrame:
        return marts.fct_data_quality_monthly(self.hourly, self.prices, self.weather, self.index)

    @cached_property
    def complete_years(self) -> DataFrame:
        """``year_local`` of complete years. The test feeds are sparse, so the fullest year sets the scale."""
        per_year = analytics.priced_hours(self.hourly).groupBy("year_local").agg(F.count("*").alias("n"))
        fullest = per_year.agg(F.max("n")).scalar()
        return analytics.complete_years(self.hourly, fullest * 0.9).select("year_local")

    @cached_property
    def spread(self) -> DataFrame:
        return marts.spread_monthly(self.hourly)

    # ---- consumers and strategies -------------------------------------------
    @mart
    def consumer_load(self) -> DataFrame:
        return profile.hourly_load(self.spine, [MAIN_PROFILE, FLAT_PROFILE])

    @mart
    def spot(self) -> DataFrame:
        return strategies.monthly_spot(self.consumer_load, self.hourly)

    @cached_property
    def observed_index(self) -> DataFrame:
        return strategies.observed_index(self.monthly)

    @cached_property
    def anchors(self) -> DataFrame:
        ref = strategies.reference_stats(self.consumer_load, self.hourly, self.cfg.reference_year)
        return strategies.anchors(ref, self.observed_index, self.cfg.reference_year)

    @cached_property
    def peak_share(self) -> DataFrame:
        return profile.peak_share(self.consumer_load)

    @mart
    def scenarios(self) -> DataFrame:
        return strategies.scenario_grid(self.anchors, self.peak_share, self.cfg)

    @cached_property
    def base_params(self) -> DataFrame:
        return self.scenarios.where("scenario = 'base'")

    @mart
    def scenario_costs(self) -> DataFrame:
        return strategies.monthly_costs(self.spot, self.observed_index, self.scenarios, self.cfg)

    @cached_property
    def costs(self) -> DataFrame:
        return self.scenario_costs.where("scenario = 'base'").drop("scenario", "profile")

    # ---- forward risk ---------------------------------------------------------
    @cached_property
    def differences(self) -> DataFrame:
        return analytics.daily_differences(self.daily)

    @mart
    def labelled(self) -> DataFrame:
        """Daily differences with the fitted volatility regime of each day."""
        moves = self.differences.withColumn("series", F.lit("AT"))
        return stats.volatility_regimes(moves, ["series"], "d_t").drop("series")

    @cached_property
    def crisis_years(self) -> DataFrame:
        return risk.december_regimes(self.labelled).where("regime = 'crisis'").select("year_local")

    @cached_property
    def targets(self) -> DataFrame:
        return risk.target_months(risk.last_priced_month(self.monthly), self.cfg.horizon_months)

    @cached_property
    def pool(self) -> DataFrame:
        return risk.bootstrap_pool(self.observed_index, self.crisis_years, self.cfg)

    @cached_property
    def main_load(self) -> DataFrame:
        return self.consumer_load.where(F.col("profile") == MAIN_PROFILE.name)

    @mart
    def cells(self) -> DataFrame:
        return risk.price_cells(self.main_load, self.hourly, self.observed_index, self.targets, self.pool)

    @cached_property
    def paths_in(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("path"))

    @mart
    def path_totals(self) -> DataFrame:
        """Two short rows per customer: a simulated year costs far more to walk again than to read."""
        slots = risk.lock_slots(self.observed_index, self.targets, self.cfg.lock_months)
        return risk.path_totals(self.paths_in, self.cells, slots, self.base_params, self.cfg)

    @cached_property
    def path_costs(self) -> DataFrame:
        """Twelve rows per customer, never written: its users aggregate it as it is computed."""
        return risk.strategy_costs(self.path_totals, self.cfg)

    @mart
    def risk_summary(self) -> DataFrame:
        return risk.risk_summary(self.path_costs)


    def close(self) -> None:
        """Remove the tables of this session and folder."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.scratch)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_OPEN: dict[tuple[str, str], Feeds] = {}


def feeds_for(spark: SparkSession, sf_dir: str) -> Feeds:
    """The feeds of one session and folder; later queries reuse its tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Feeds(spark, sf_dir)
    return _OPEN[key]


def close_feeds(spark: SparkSession) -> None:
    """Forget the feeds of a session and delete their tables, also before input folders change."""
    for key in [k for k in _OPEN if k[0] == spark.sparkContext.applicationId]:
        _OPEN.pop(key).close()
