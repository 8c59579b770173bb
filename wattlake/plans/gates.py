"""Ingestion and result gates.

Each gate returns evidence rows with an ``ok`` column. Years are local years;
a year the data does not fully span is reported with scope ``boundary`` and
never fails.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlake import config as cfg
from wattlake.functions import timecols as tc
from wattlake.functions.exprs import avg_if, outside
from wattlake.operators.joins import with_bounds
from wattlake.operators.series import relative_change
from wattlake.operators.spine import month_spine


def span_of(*frames: DataFrame) -> DataFrame:
    """One row with the first and last local time over all frames."""
    spans = None
    for f in frames:
        local = tc.local_time(F.col("ts_utc"))
        row = f.agg(F.min(local).alias("lo"), F.max(local).alias("hi"))
        spans = row if spans is None else spans.unionByName(row)
    return spans.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def with_zone_span(yearly: DataFrame) -> DataFrame:
    """``lo`` and ``hi`` of each zone-year widened to the whole span of its zone; ``yearly`` is one row per zone and year."""
    zone = Window.partitionBy("zone")
    return yearly.withColumn("lo", F.min("lo").over(zone)).withColumn("hi", F.max("hi").over(zone))


def _zone_years(hourly: DataFrame, *aggregates: Column) -> DataFrame:
    """The aggregates per zone and local year, with the span of the zone; one pass over the hours."""
    local = tc.local_time(F.col("ts_utc"))
    yearly = hourly.groupBy("zone", _local_year().alias("year")).agg(*aggregates, F.min(local).alias("lo"), F.max(local).alias("hi"))
    return with_zone_span(yearly)


def is_complete_year(year: Column) -> Column:
    """The span in scope (``lo``, ``hi``) covers the year, with a day of grace at both ends."""
    return (F.col("lo") <= F.make_date(year, F.lit(1), F.lit(2)).cast("timestamp")) & (
        F.col("hi") >= F.make_date(year, F.lit(12), F.lit(31)).cast("timestamp")
    )


def _scope(year: Column) -> Column:
    return F.when(is_complete_year(year), "complete").otherwise("boundary")


def _local_year() -> Column:
    return F.year(tc.local_time(F.col("ts_utc")))


def hour_coverage(hourly: DataFrame) -> DataFrame:
    """Hours per zone-year against the calendar, plus 23/25-hour days of complete years.

    ``hourly`` has ``zone, ts_utc``. One aggregation to (zone, local day)
    feeds both checks.
    """
    local_day = F.to_date(tc.local_time(F.col("ts_utc"))).alias("day")
    hour = F.date_trunc("hour", "ts_utc")
    per_day = hourly.groupBy("zone", local_day).agg(F.count_distinct(hour).alias("hours"))
    per_day = with_bounds(per_day.withColumn("year", F.year("day")), span_of(hourly))
    year = F.col("year")
    expected = F.when(tc.is_leap_year(year), F.lit(8784)).otherwise(F.lit(8760))
    coverage = per_day.groupBy("zone", "year", _scope(year).alias("scope")).agg(
        F.sum("hours").alias("actual")
    ).select(
        "zone", "year", F.lit("coverage").alias("check"), expected.cast("bigint").alias("expected"), "actual",
        (expected - F.col("actual")).cast("bigint").alias("missing_hours"), "scope",
    )
    march, october = tc.last_sunday(year, 3), tc.last_sunday(year, 10)
    on_dst = per_day.where(is_complete_year(year) & ((F.col("day") == march) | (F.col("day") == october)))
    dst = on_dst.select(
        "zone", "year", F.when(F.col("day") == march, "dst_mar").otherwise("dst_oct").alias("check"),
        tc.hours_in_local_day(F.col("day")).cast("bigint").alias("expected"), F.col("hours").alias("actual"),
        F.lit(None).cast("bigint").alias("missing_hours"), F.lit("complete").alias("scope"),
    )
    ok = (
        F.when(F.col("check") != "coverage", F.col("expected") == F.col("actual"))
        .when(F.col("scope") == "complete", F.col("missing_hours") <= cfg.MAX_MISSING_HOURS)
        .otherwise(F.lit(True))
    )
    return coverage.unionByName(dst).withColumn("ok", ok)


def price_plausibility(hourly: DataFrame, low: float = cfg.PRICE_BOUNDS[0], high: float = cfg.PRICE_BOUNDS[1]) -> DataFrame:
    """Failing rows: hourly prices outside the market's technical limits."""
    return hourly.where(outside(F.col("price_eur_mwh"), low, high))


def annual_mean_plausibility(hourly: DataFrame, bounds: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """Annual mean of each zone against its per-year range; a complete year without a range fails."""
    table = cfg.ANNUAL_MEAN_BOUNDS if bounds is None else bounds
    limits = F.create_map(*[x for y, (a, b) in table.items() for x in (
        F.lit(y), F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")))])
    rows = _zone_years(hourly, F.avg("price_eur_mwh").alias("mean_price"))
    rows = rows.withColumn("limit", F.try_element_at(limits, F.col("year")))
    inside = F.coalesce(F.col("mean_price").between(F.col("limit.low"), F.col("limit.high")), F.lit(False))
    scope = _scope(F.col("year"))
    return rows.select(
        "zone", "year", F.col("mean_price").alias("mean_price_eur_mwh"),
        F.col("limit.low").alias("low"), F.col("limit.high").alias("high"),
        scope.alias("scope"), (inside | (scope == "boundary")).alias("ok"),
    )


def negatives_present(hourly: DataFrame, years: Sequence[int]) -> DataFrame:
    """Each complete required year of each zone must show at least one negative price."""
    rows = _zone_years(hourly, F.count_if(F.col("price_eur_mwh") < 0).alias("n_negative"))
    return rows.where(F.col("year").isin(*years) & is_complete_year(F.col("year"))).select(
        "zone", "year", "n_negative", (F.col("n_negative") > 0).alias("ok")
    )


def load_plausibility(hourly: DataFrame) -> DataFrame:
    """Hourly band for every row and annual-mean band for complete years."""
    low, high = cfg.LOAD_HOURLY_BOUNDS
    yearly = hourly.groupBy(_local_year().alias("year")).agg(
        F.avg("load_mw").alias("annual_mean_mw"),
        F.count_if(outside(F.col("load_mw"), low, high)).alias("n_out_of_band"),
    )
    rows = with_bounds(yearly, span_of(hourly))
    inside = F.col("annual_mean_mw").between(*cfg.LOAD_ANNUAL_BOUNDS)
    scope = _scope(F.col("year"))
    return rows.select(
        "year", "annual_mean_mw", "n_out_of_band", scope.alias("scope"),
        ((F.col("n_out_of_band") == 0) & (inside | (scope == "boundary"))).alias("ok"),
    )


def join_coverage(prices: DataFrame, load: DataFrame) -> DataFrame:
    """Share of priced hours of each zone that also have a load value, per local year."""
    has_load = load.select("ts_utc").distinct().withColumn("has_load", F.lit(True))
    hours = prices.select("zone", "ts_utc").distinct().join(has_load, "ts_utc", "left")
    rows = _zone_years(hours, F.count("*").alias("price_hours"), F.count("has_load").alias("matched_hours"))
    loaded = span_of(load)
    rows = rows.withColumn("lo", F.least("lo", loaded.select("lo").scalar())).withColumn("hi", F.greatest("hi", loaded.select("hi").scalar()))
    share = F.col("matched_hours") / F.col("price_hours")
    scope = _scope(F.col("year"))
    return rows.select(
        "zone", "year", "price_hours", "matched_hours", F.round(share, 4).alias("coverage"), scope.alias("scope"),
        ((share >= cfg.JOIN_COVERAGE_MIN) | (scope == "boundary")).alias("ok"),
    )


def weather_checks(weather: DataFrame, first: Column, last: Column) -> DataFrame:
    """Coverage of a given window, value range and the seasonal means, from one pass."""
    day, temp = F.col("date_local"), F.col("tavg_c")
    low, high = cfg.TEMPERATURE_BOUNDS
    one = weather.agg(
        F.count_distinct(F.when(day.between(first, last) & temp.isNotNull(), day)).alias("covered"),
        (F.datediff(F.max(last), F.max(first)) + 1).alias("days"),
        F.count_if(outside(temp, low, high)).alias("n_range"),
        avg_if(F.month(day) == 7, temp).alias("july"),
        avg_if(F.month(day) == 1, temp).alias("january"),
    )
    share = F.col("covered") / F.col("days")

    def mean_ok(col: str, bounds: tuple[float, float]) -> Column:
        return F.col(col).isNull() | F.col(col).between(*bounds)

    checks = F.array(
        F.struct(F.lit("coverage").alias("check"), share.alias("actual"),
                 (share >= cfg.WEATHER_COVERAGE_MIN).alias("ok")),
        F.struct(F.lit("range").alias("check"), F.col("n_range").cast("double").alias("actual"),
                 (F.col("n_range") == 0).alias("ok")),
        F.struct(F.lit("july_mean").alias("check"), F.col("july").alias("actual"),
                 mean_ok("july", cfg.JULY_MEAN_BOUNDS).alias("ok")),
        F.struct(F.lit("january_mean").alias("check"), F.col("january").alias("actual"),
                 mean_ok("january", cfg.JANUARY_MEAN_BOUNDS).alias("ok")),
    )
    return one.select(F.inline(checks))


def index_checks(index: DataFrame, base_year: int = 2019, crisis_year: int = 2022) -> DataFrame:
    """Continuity, positivity, crisis visibility and monthly change of the index series."""
    month = F.col("month_local")
    bounds = index.agg(F.min(month).alias("first_day"), F.max(month).alias("last_day"))
    gaps = month_spine(bounds, "month_local").join(index.select("month_local"), "month_local", "left_anti")
    moves = relative_change(index.withColumn("series", F.lit(1)), ["series"], "month_local", "oespi_base", "mom")
    one = moves.agg(
        F.count_if((F.col("oespi_base") <= 0)).alias("bad_base"),
        F.count_if(F.col("oespi_peak") <= 0).alias("bad_peak"),
        avg_if(F.year(month) == base_year, F.col("oespi_base")).alias("calm_mean"),
        F.max(F.when(F.year(month) == crisis_year, F.col("oespi_base"))).alias("crisis_max"),
        F.count_if(F.abs("mom") > cfg.INDEX_MAX_MONTHLY_CHANGE).alias("jumps"),
    ).withColumn("missing", gaps.agg(F.count("*")).scalar())
    bad = F.col("bad_base") + F.col("bad_peak")
    multiple = F.try_divide(F.col("crisis_max"), F.col("calm_mean"))
    checks = F.array(
        F.struct(F.lit("continuity").alias("check"), F.col("missing").cast("double").alias("actual"),
                 (F.col("missing") == 0).alias("ok")),
        F.struct(F.lit("positivity").alias("check"), bad.cast("double").alias("actual"), (bad == 0).alias("ok")),
        F.struct(F.lit("crisis_visibility").alias("check"), multiple.alias("actual"),
                 F.coalesce(F.col("crisis_max") >= cfg.INDEX_CRISIS_MULTIPLE * F.col("calm_mean"), F.lit(False)).alias("ok")),
        F.struct(F.lit("mom_change").alias("check"), F.col("jumps").cast("double").alias("actual"),
                 (F.col("jumps") == 0).alias("ok")),
    )
    return one.select(F.inline(checks))


def calendar_checks(calendar: DataFrame, holidays: DataFrame, year: int, work_monday: str, sunday: str) -> DataFrame:
    """Holiday set equality both ways, fixed holidays, and two peak-hour spot checks."""
    flagged = calendar.where((F.col("year_local") == year) & F.col("is_holiday_at")).select("date_local").distinct()
    expected = holidays.where(F.col("year") == year).select("date_local").distinct()
    extra = flagged.join(expected, "date_local", "left_anti").agg(F.count("*")).scalar()
    absent = expected.join(flagged, "date_local", "left_anti").agg(F.count("*")).scalar()
    fixed = [f"{year}-01-01", f"{year}-05-01", f"{year}-12-25"]
    day, ten = F.col("date_local"), F.col("hour_local") == 10
    one = calendar.where(F.col("year_local") == year).agg(
        F.count_distinct(F.when(F.col("is_holiday_at") & day.cast("string").isin(*fixed), day)).alias("n_fixed"),
        F.bool_or(F.when(ten & (day == F.lit(work_monday).cast("date")), F.col("is_peak_hour"))).alias("monday"),
        F.bool_or(F.when(ten & (day == F.lit(sunday).cast("date")), F.col("is_peak_hour"))).alias("sunday"),
    ).withColumn("n_off", extra + absent)
    checks = F.array(
        F.struct(F.lit("holiday_set").alias("check"), (F.col("n_off") == 0).alias("ok")),
        F.struct(F.lit("fixed_holidays").alias("check"), (F.col("n_fixed") == 3).alias("ok")),
        F.struct(F.lit("peak_hour_mon_sun").alias("check"),
                 (F.coalesce("monday", F.lit(False)) & ~F.coalesce("sunday", F.lit(True))).alias("ok")),
    )
    return one.select(F.inline(checks))


def dst_day_failures(hourly: DataFrame, fixed: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """Daylight-saving days of complete years (plus fixed days) with a wrong or absent hour count."""
    per_day = hourly.groupBy("date_local", "year_local").agg(F.count("*").alias("n_hours"))
    year = F.col("year_local")
    years = per_day.groupBy("year_local").agg(
        F.min("date_local").alias("lo"), F.max("date_local").alias("hi")
    ).where((F.col("lo") == F.make_date(year, F.lit(1), F.lit(1))) & (F.col("hi") == F.make_date(year, F.lit(12), F.lit(31))))
    derived = years.select(F.inline(F.array(
        F.struct(tc.last_sunday(year, 3).alias("date_local"), F.lit(23).alias("expected_hours")),
        F.struct(tc.last_sunday(year, 10).alias("date_local"), F.lit(25).alias("expected_hours")),
    )))
    expected = derived
    if fixed:
        rows = hourly.sparkSession.createDataFrame([(d, n) for d, n in fixed], "d string, expected_hours int")
        expected = derived.union(rows.select(F.to_date("d"), "expected_hours")).distinct()
    actual = per_day.join(expected.select("date_local"), "date_local", "left_semi").select("date_local", "n_hours")
    return expected.join(actual, "date_local", "left").where(
        F.col("n_hours").isNull() | (F.col("n_hours") != F.col("expected_hours"))
    )


def year_row_count_failures(hourly: DataFrame) -> DataFrame:
    year = F.col("year_local")
    rows = hourly.groupBy("year_local").agg(
        F.count("*").alias("n_hours"), F.min("date_local").alias("lo"), F.max("date_local").alias("hi")
    ).select(
        "year_local", "n_hours",
        F.when(tc.is_leap_year(year), 8784).otherwise(8760).alias("expected_hours"),
        ((F.col("lo") == F.make_date(year, F.lit(1), F.lit(1)))
         & (F.col("hi") == F.make_date(year, F.lit(12), F.lit(31)))).alias("is_complete_year"),
    )
    off = F.abs(F.col("n_hours") - F.col("expected_hours")) > cfg.MAX_MISSING_HOURS
    edge = (F.col("n_hours") < 1) | (F.col("n_hours") > F.col("expected_hours"))
    return rows.where(F.when(F.col("is_complete_year"), off).otherwise(edge))


def stale(
    df: DataFrame, ts: str, now: Column, limit_days: int = cfg.FRESHNESS_LIMIT_DAYS, keys: Sequence[str] = ()
) -> DataFrame:
    """A row for each key, or one without keys, when the newest timestamp is too old or there is none."""
    newest = (df.groupBy(*keys) if keys else df).agg(F.max(ts).alias("newest_ts_utc"))
    limit = now - F.make_dt_interval(days=F.lit(limit_days))
    return newest.where(F.col("newest_ts_utc").isNull() | (F.col("newest_ts_utc") < limit))


def month_gap_failures(price_monthly: DataFrame, generation_monthly: DataFrame, cost_monthly: DataFrame) -> DataFrame:
    """Missing months on a common window, cost months outside it, and empty marts."""
    names = {
        "fct_price_monthly": price_monthly, "fct_generation_monthly": generation_monthly,
        "fct_procurement_cost_monthly": cost_monthly,
    }
    months = {
        n: f.select(tc.month_of(F.col("year_local"), F.col("month_local")).alias("month_local")).distinct()
        for n, f in names.items()
    }
    price, generation, cost = months.values()

    def spine(df: DataFrame) -> DataFrame:
        return month_spine(df.agg(F.min("month_local").alias("first_day"), F.max("month_local").alias("last_day")), "month_local")

    def tagged(df: DataFrame, mart: str, failure: str) -> DataFrame:
        return df.select(F.lit(mart).alias("mart_name"), F.lit(failure).alias("failure"), "month_local")

    common = spine(price.union(generation))
    outside_window = with_bounds(
        cost, price.agg(F.min("month_local").alias("lo"), F.max("month_local").alias("hi"))
    ).where((F.col("month_local") < F.col("lo")) | (F.col("month_local") > F.col("hi")))
    out = tagged(common.join(price, "month_local", "left_anti"), "fct_price_monthly", "missing_month")
    out = out.union(tagged(common.join(generation, "month_local", "left_anti"), "fct_generation_monthly", "missing_month"))
    out = out.union(tagged(spine(cost).join(cost, "month_local", "left_anti"), "fct_procurement_cost_monthly", "missing_month"))
    out = out.union(tagged(outside_window, "fct_procurement_cost_monthly", "outside_price_window"))
    for name, frame in months.items():
        empty = frame.agg(F.count("*").alias("n")).where("n = 0").withColumn("month_local", F.lit(None).cast("date"))
        out = out.union(tagged(empty, name, "empty_mart"))
    return out


def grain_mismatch(hourly: DataFrame, monthly: DataFrame, year: int, month: int, tolerance: float = 0.01) -> DataFrame:
    """Monthly mart against the mean of its hours; absent or NULL counts as a failure."""
    pick = (F.col("year_local") == year) & (F.col("month_local") == month)
    checked = monthly.where(pick).agg(
        F.max("price_base_eur_mwh").alias("price_base_eur_mwh"), F.count("*").alias("n_monthly_rows")
    ).withColumn("mean_price", hourly.where(pick).agg(F.avg("price_at_eur_mwh")).scalar())
    return checked.where(
        (F.col("n_monthly_rows") != 1) | F.col("price_base_eur_mwh").isNull() | F.col("mean_price").isNull()
        | (F.abs(F.col("price_base_eur_mwh") - F.col("mean_price")) > tolerance)
    )


def strategy_relations(annual: DataFrame, summary: DataFrame, crisis_year: int) -> DataFrame:
    """(a) spot beats nothing in the crisis year, (b) the hybrid lies between, (c) spot has the fatter tail."""
    sid, cost = F.col("strategy_id"), F.col("cost_eur")
    wide = annual.where(sid.isin("S1", "S3", "S4_50")).groupBy("year").agg(
        *[F.max(F.when(sid == s, cost)).alias(s) for s in ("S1", "S3", "S4_50")]
    )
    tol = cfg.HYBRID_TOLERANCE
    inside = F.col("S4_50").between(F.least("S1", "S3") * (1 - tol), F.greatest("S1", "S3") * (1 + tol))
    a = wide.where(F.col("year") == crisis_year).select(
        F.lit("spot_above_fixed").alias("check"), "year", (F.col("S1") > F.col("S3")).alias("ok")
    )
    b = wide.select(F.lit("hybrid_between").alias("check"), "year", inside.alias("ok"))
    c = summary.where(F.col("variant") == "unconditional").agg(
        F.max(F.when(sid == "S1", F.col("p95"))).alias("s1"), F.max(F.when(sid == "S3", F.col("p95"))).alias("s3")
    ).select(F.lit("spot_tail_above_fixed").alias("check"), F.lit(None).cast("int").alias("year"),
             F.coalesce(F.col("s1") >= F.col("s3"), F.lit(False)).alias("ok"))
    return a.unionByName(b).unionByName(c)


def number_table_problems(rows: DataFrame, required: Sequence[str], verified_prefixes: Sequence[str]) -> DataFrame:
    """Missing required keys, duplicate keys, and VERIFIED rows from other producers."""
    spark = rows.sparkSession
    need = spark.createDataFrame([(k,) for k in required], "key string")
    missing = need.join(rows.select("key"), "key", "left_anti").select(F.lit("missing_key").alias("problem"), "key")
    repeated = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(
        F.lit("duplicate_key").alias("problem"), "key"
    )
    allowed = F.lit(False)
    for p in verified_prefixes:
        allowed = allowed | F.startswith(F.col("produced_by"), F.lit(p))
    wrong = rows.where((F.col("tag") == "VERIFIED") & ~allowed).select(
        F.lit("unverified_producer").alias("problem"), "key"
    )
    return missing.union(repeated).union(wrong)


def quality_indicators(monthly: DataFrame, today: Column) -> DataFrame:
    """Headline indicators: freshness, incomplete months, months not on hourly resolution."""
    month = tc.month_of(F.col("year_local"), F.col("month_local"))
    return monthly.agg(
        F.datediff(F.max(today), F.last_day(F.max(month))).alias("freshness_days"),
        F.count_if(F.col("coverage_at_pct") < 100).alias("months_below_full"),
        F.count_if(F.col("resolution") != "PT60M").alias("months_not_hourly"),
        F.sum("n_dst_days").alias("dst_days"),
        F.sum("n_negative_hours").alias("negative_hours"),
    ).withColumn("is_fresh", F.col("freshness_days") < cfg.FRESHNESS_LIMIT_DAYS)


def latest_complete_month(hourly: DataFrame) -> DataFrame:
    """Latest month for which every zone has data on each of its days (one row)."""
    day = F.to_date("ts_utc")
    monthly = hourly.groupBy("zone", F.trunc(day, "MM").alias("month_start")).agg(
        F.count_distinct(day).alias("days")
    )
    complete = monthly.where(F.col("days") == F.dayofmonth(F.last_day("month_start")))
    per_zone = complete.groupBy("zone").agg(F.max("month_start").alias("latest"))
    n_zones = hourly.agg(F.count_distinct("zone")).scalar()
    return per_zone.agg(F.count("*").alias("n"), F.min("latest").alias("latest")).select(
        F.when(F.col("n") == n_zones, F.col("latest")).alias("latest_complete_month")
    )
