"""Load profile and pricing engine against known results and first principles."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from wattlake.config import FLAT_PROFILE, MAIN_PROFILE, StrategyConfig
from wattlake.functions.hashing import series_checksum
from wattlake.functions.timecols import hours_in_local_day
from wattlake.operators.spine import calendar_spine, easter_sundays, holiday_dimension
from wattlake.plans import gates, profile, strategies

# Fixed value: sha256 of the 2023 reference load at six decimals.
LOAD_2023 = "e33560dc5db73820db761b4b9fd37d872baa8207d300e33878d005f97a98e548"
CFG = StrategyConfig()


def bounds(spark, first, last):
    return spark.createDataFrame([(first, last)], "first_day date, last_day date")


@pytest.fixture(scope="module")
def calendar(spark):
    return calendar_spine(bounds(spark, date(2022, 1, 1), date(2024, 12, 31))).cache()


def test_reference_year_checksum(calendar):
    load = profile.hourly_load(calendar, [MAIN_PROFILE]).where("year_local = 2023")
    assert series_checksum(load, ["year_local"], "ts_utc", "load_mwh").first().sha256 == LOAD_2023


def test_annual_volume_and_partial_year(spark, calendar):
    full = profile.hourly_load(calendar, [MAIN_PROFILE, FLAT_PROFILE])
    for row in full.groupBy("profile", "year_local").agg(F.sum("load_mwh").alias("v"), F.min("load_mwh").alias("low")).collect():
        assert row.v == pytest.approx(50000.0, rel=1e-9)
        assert row.low > 0
    part = calendar_spine(bounds(spark, date(2023, 1, 1), date(2023, 6, 30)))
    got = {r.month_local: r.volume_mwh for r in profile.monthly_volumes(profile.hourly_load(part, [MAIN_PROFILE])).collect()}
    want = {r.month_local: r.volume_mwh for r in profile.monthly_volumes(
        full.where("profile = 'main' and year_local = 2023")).collect() if r.month_local <= 6}
    assert got == pytest.approx(want, rel=1e-9)


def test_daylight_saving_days(spark, calendar):
    hours = {r.date_local: r["count"] for r in calendar.groupBy("date_local").count().collect()}
    assert hours[date(2024, 3, 31)] == 23 and hours[date(2024, 10, 27)] == 25 and hours[date(2024, 6, 1)] == 24
    row = spark.range(1).select(hours_in_local_day(F.lit("2024-03-31").cast("date")).alias("h")).first()
    assert row.h == 23


def test_holidays(spark, calendar):
    years = spark.createDataFrame([(y,) for y in (2019, 2022, 2024, 2025)], "year int")
    easter = {r.year: r.easter for r in easter_sundays(years).collect()}
    assert easter == {2019: date(2019, 4, 21), 2022: date(2022, 4, 17), 2024: date(2024, 3, 31), 2025: date(2025, 4, 20)}
    days = {r.date_local for r in holiday_dimension(years).where("year = 2024").collect()}
    assert len(days) == 13 and {date(2024, 4, 1), date(2024, 5, 9), date(2024, 5, 20), date(2024, 5, 30)} <= days
    checks = gates.calendar_checks(calendar, holiday_dimension(years), 2024, "2024-01-08", "2024-01-07")
    assert all(r.ok for r in checks.collect())


def market(spark):
    """Seven years of monthly spot costs and index values drawn with a fixed seed, with the matching parameters."""
    draw = random.Random(11).uniform
    spot, index = [], []
    for year in range(2019, 2026):
        for month in range(1, 13):
            volume, base = draw(2500.0, 5000.0), draw(80.0, 500.0)
            spot.append(("main", year, month, volume, volume * draw(-5.0, 300.0)))
            index.append((year, month, base, base * draw(0.7, 1.3)))
    s = spark.createDataFrame(spot, "profile string, year_local int, month_local int, volume_mwh double, spot_cost_eur double")
    x = spark.createDataFrame(index, "year_local int, month_local int, oespi_base double, oespi_peak double")
    p = spark.createDataFrame(
        [("main", 40.0, 42.0, 100.0, 85.0, 0.48, "base", 5.0, list(CFG.lock_months))],
        "profile string, p_ref_base double, p_ref_peak double, oespi_base_ref double, oespi_peak_ref double, "
        "w_peak double, scenario string, premium double, lock_months array<int>")
    return s, x, p


def python_costs(spark, year):
    """The same year priced month by month in plain Python."""
    s, x, _ = market(spark)
    idx = {(r.year_local, r.month_local): (r.oespi_base, r.oespi_peak) for r in x.collect()}

    def blend(b, p):
        return 40.0 * b / 100.0 * 0.52 + 42.0 * p / 85.0 * 0.48

    window = [idx[(year - 1, m)] for m in CFG.lock_months]
    lock = blend(sum(w[0] for w in window) / 6, sum(w[1] for w in window) / 6) + 5.0
    s1 = s2 = s3 = 0.0
    for r in s.where(f"year_local = {year}").collect():
        s1 += r.spot_cost_eur
        s2 += r.volume_mwh * blend(*idx[(year, r.month_local)])
        s3 += r.volume_mwh * lock
    return {"S1": s1, "S2": s2, "S3": s3, "S4_30": 0.3 * s3 + 0.7 * s1, "S4_50": 0.5 * (s1 + s3), "S4_70": 0.7 * s3 + 0.3 * s1}


def test_yearly_costs_equal_plain_python(spark):
    s, x, p = market(spark)
    annual = strategies.annual_summary(strategies.monthly_costs(s, x, p, CFG)).collect()
    assert len(annual) == 30
    for year in CFG.years:
        want = python_costs(spark, year)
        got = {r.strategy_id: r for r in annual if r.year == year}
        for sid, cost in want.items():
            assert got[sid].cost_eur == pytest.approx(cost, rel=1e-9)
            assert got[sid].delta_vs_min_eur == pytest.approx(cost - min(want.values()), abs=1e-4)
            assert got[sid]["rank"] == 1 + sum(c < cost - 1e-6 for c in want.values())


def test_costs_of_a_flat_market(spark):
    """10 MWh a month at 50 EUR, the index at its reference: all by hand from 40 * 0.52 + 42 * 0.48 = 40.96 EUR."""
    s, x, p = market(spark)
    s = s.withColumn("volume_mwh", F.lit(10.0)).withColumn("spot_cost_eur", F.lit(500.0))
    x = x.withColumn("oespi_base", F.lit(100.0)).withColumn("oespi_peak", F.lit(85.0))
    annual = strategies.annual_summary(strategies.monthly_costs(s, x, p, CFG)).where("year = 2021").collect()
    got = {r.strategy_id: (r.cost_eur, r["rank"]) for r in annual}
    want = {"S1": 6000.0, "S2": 4915.2, "S3": 5515.2, "S4_30": 5854.56, "S4_50": 5757.6, "S4_70": 5660.64}
    assert {k: v for k, (v, _) in got.items()} == pytest.approx(want, rel=1e-9)
    assert sorted(got, key=lambda k: got[k][1]) == ["S2", "S3", "S4_70", "S4_50", "S4_30", "S1"]


def test_lock_price_never_looks_ahead(spark):
    _, x, p = market(spark)
    before = {r.year_local: r.lock_price for r in strategies.lock_prices(x, p, CFG.years).collect()}
    inside = (F.col("year_local") == 2021) & (F.col("month_local") >= 7)
    moved = x.withColumn("oespi_base", F.when(inside, F.col("oespi_base")).otherwise(F.col("oespi_base") * 3))
    after = {r.year_local: r.lock_price for r in strategies.lock_prices(moved, p, CFG.years).collect()}
    assert after[2022] == pytest.approx(before[2022], rel=1e-12)
    assert after[2023] != pytest.approx(before[2023])


def test_incomplete_lock_window_is_an_error(spark):
    _, x, p = market(spark)
    with pytest.raises(Exception, match="lock window incomplete"):
        strategies.lock_prices(x.where("not (year_local = 2021 and month_local = 9)"), p, CFG.years).collect()


def test_missing_index_is_an_error(spark):
    s, x, p = market(spark)
    holed = x.where("not (year_local = 2023 and month_local = 2)")
    assert strategies.missing_index_months(s, holed, CFG.years).count() == 1
    with pytest.raises(Exception, match="index missing"):
        strategies.monthly_costs(s, holed, p, CFG).collect()


def test_wrong_strategy_cost_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(2021, "S1", 5.0), (2021, "S2", 5.0), (2021, "S3", 9.0)], "year int, strategy_id string, cost_eur double")
    r = strategies.wrong_strategy_cost(rows).first()
    assert (r.wrong_strategy_cost_eur, r.worst_strategy, r.best_strategy) == (4.0, "S3", "S1")


def test_consumers_keep_their_own_prices_and_an_unlisted_one_is_an_error(spark):
    s, x, p = market(spark)
    other = p.withColumn("profile", F.lit("other")).withColumn("p_ref_base", F.col("p_ref_base") * 2).withColumn("p_ref_peak", F.col("p_ref_peak") * 2)
    both = s.unionByName(s.withColumn("profile", F.lit("other")))
    got = strategies.annual_summary(strategies.monthly_costs(both, x, p.unionByName(other), CFG), ["profile"])
    alone = strategies.annual_summary(strategies.monthly_costs(s, x, p, CFG))
    mine = {(r.year, r.strategy_id): r.cost_eur for r in got.where("profile <> 'other'").collect()}
    assert mine == pytest.approx({(r.year, r.strategy_id): r.cost_eur for r in alone.collect()})
    theirs = {(r.year, r.strategy_id): r.cost_eur for r in got.where("profile = 'other'").collect()}
    assert all(theirs[y, "S1"] == pytest.approx(mine[y, "S1"]) and theirs[y, "S2"] == pytest.approx(2 * mine[y, "S2"]) for y, _ in mine)
    with pytest.raises(Exception, match="no strategy parameters for profile other"):
        strategies.monthly_costs(both, x, p, CFG).collect()
