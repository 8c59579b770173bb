"""Forward risk: alignment, cell pricing, draws and path totals against plain Python."""

from __future__ import annotations

import hashlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlake.config import MAIN_PROFILE, StrategyConfig
from wattlake.operators.spine import calendar_spine
from wattlake.plans import profile, risk

CFG = StrategyConfig(horizon_months=3, lock_months=(11, 12))


@pytest.fixture(scope="module")
def market(spark):
    """Three years of hourly prices with holes, and the forward load of the next quarter."""
    bounds = spark.createDataFrame([(date(2021, 1, 1), date(2024, 3, 31))], "first_day date, last_day date")
    calendar = calendar_spine(bounds).cache()
    hour = F.unix_seconds("ts_utc") / 3600
    price = F.when((F.col("year_local") < 2024) & (F.col("hour_local") % 5 != 3), 50 + 40 * F.sin(hour) + F.col("month_local"))
    hourly = calendar.withColumn("price_at_eur_mwh", price).cache()
    load = profile.hourly_load(calendar, [MAIN_PROFILE]).cache()
    index = calendar.where("year_local < 2024").select("year_local", "month_local").distinct().select(
        "*", (F.col("year_local") - 2000.0 + F.col("month_local")).alias("oespi_base"),
        (F.col("year_local") - 1990.0 - F.col("month_local")).alias("oespi_peak")).cache()
    targets = risk.target_months(spark.createDataFrame([(date(2023, 12, 1),)], "last_month date"), 3)
    excluded = spark.createDataFrame([(2022,)], "year_local int")
    pool = risk.bootstrap_pool(index, excluded, CFG)
    cells = risk.price_cells(load, hourly, index, targets, pool).cache()
    return {"calendar": calendar, "hourly": hourly, "load": load, "index": index, "targets": targets, "pool": pool, "cells": cells}


def test_targets_follow_the_last_priced_month(market):
    got = [(r.target_idx, r.year_local, r.month_local) for r in market["targets"].orderBy("target_idx").collect()]
    assert got == [(0, 2024, 1), (1, 2024, 2), (2, 2024, 3)]


def test_pool_leaves_out_crisis_years(market):
    rows = market["pool"].where("month_local = 2").collect()
    got = {v: [r.pool_year for r in sorted(rows, key=lambda r: r.pool_idx) if r.variant == v] for v in CFG.variants}
    assert got == {"unconditional": [2021, 2022, 2023], "no_crisis": [2021, 2023]}


def loop_align(drawn, target):
    """Hour-by-hour alignment in plain Python."""
    by_key, days = {}, {}
    for r in drawn:
        by_key.setdefault((r.date_local.day, r.hour_local), []).append(r.price_at_eur_mwh)
        days[r.date_local.day] = r.is_weekend or r.is_holiday_at
    last = max(days)
    out = []
    for r in sorted(target, key=lambda r: r.ts_utc):
        free = r.is_weekend or r.is_holiday_at
        day = r.date_local.day
        if day > last:
            day = max((d for d, f in days.items() if f == free), default=last)
        found = by_key.get((day, r.hour_local))
        out.append(np.mean(found) if found else (out[-1] if out else None))
    first = next(v for v in out if v is not None)
    return [first if v is None else v for v in out]


def test_cells_equal_the_hour_loop(market):
    cells = {(r.target_idx, r.pool_year): r for r in market["cells"].where("variant = 'unconditional'").collect()}
    assert len(cells) == 9
    prices = market["hourly"].where("price_at_eur_mwh is not null").collect()
    loads = market["load"].where("year_local = 2024").collect()
    for (idx, year), cell in cells.items():
        target = sorted((r for r in loads if r.month_local == idx + 1), key=lambda r: r.ts_utc)
        drawn = [r for r in prices if r.year_local == year and r.month_local == idx + 1]
        want = float(np.dot([r.load_mwh for r in target], loop_align(drawn, target)))
        assert cell.spot_cost_eur == pytest.approx(want, rel=1e-9)
        assert cell.volume_mwh == pytest.approx(sum(r.load_mwh for r in target), rel=1e-9)


PARAMS = dict(p_ref_base=40.0, p_ref_peak=42.0, oespi_base_ref=20.0, oespi_peak_ref=30.0, w_peak=0.4, premium=5.0)


def run_paths(spark, market, n, parts):
    params = spark.createDataFrame([tuple(PARAMS.values())], ", ".join(f"{k} double" for k in PARAMS))
    slots = risk.lock_slots(market["index"], market["targets"], CFG.lock_months)
    paths = spark.range(n).withColumnRenamed("id", "path").repartition(parts)
    return risk.path_costs(paths, market["cells"], slots, params, CFG)


def test_paths_equal_plain_python(spark, market):
    cells = {}
    for r in market["cells"].collect():
        cells.setdefault((r.variant, r.target_idx), {})[r.pool_idx] = r
    index = {(r.year_local, r.month_local): r for r in market["index"].collect()}

    def blend(b, p):
        return PARAMS["p_ref_base"] * b / 20.0 * 0.6 + PARAMS["p_ref_peak"] * p / 30.0 * 0.4

    got = {(r.variant, r.path, r.strategy_id): r.cost_eur for r in run_paths(spark, market, 40, 3).collect()}
    assert len(got) == 2 * 40 * 6
    lock = blend(*(np.mean([index[(2023, m)][c] for m in (11, 12)]) for c in ("oespi_base", "oespi_peak"))) + 5.0
    for variant in CFG.variants:
        for path in range(40):
            s1 = s2 = s3 = 0.0
            for idx in range(3):
                options = cells[(variant, idx)]
                word = int(hashlib.md5(f"42|{path}|{idx}".encode()).hexdigest()[:8], 16)
                c = options[word % len(options)]
                s1 += c.spot_cost_eur
                s2 += c.volume_mwh * blend(c.oespi_base, c.oespi_peak)
                s3 += c.volume_mwh * lock
            want = {"S1": s1, "S2": s2, "S3": s3, "S4_30": 0.3 * s3 + 0.7 * s1, "S4_70": 0.7 * s3 + 0.3 * s1}
            for sid, cost in want.items():
                assert got[(variant, path, sid)] == pytest.approx(cost, rel=1e-9)


def test_paths_do_not_depend_on_partitioning(spark, market):
    a, b = run_paths(spark, market, 200, 1), run_paths(spark, market, 200, 7)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_drawn_and_carried_lock_months(market):
    slots = risk.lock_slots(market["index"], market["targets"], (1, 3, 12))
    later = slots.withColumn("delivery_year", F.col("delivery_year"))
    got = {(r.year_local, r.month_local): (r.obs_base, r.target_idx, r.last_base) for r in later.collect()}
    assert got[(2023, 12)][0] == 35.0 and got[(2023, 1)][1] is None
    shifted = market["targets"].withColumn("year_local", F.col("year_local") + 1)
    carried = {r.month_local: r for r in risk.lock_slots(market["index"], shifted, (2, 12)).collect()}
    assert carried[12].obs_base is None and carried[12].target_idx is None and carried[12].last_base == 35.0


def test_empty_pool_is_an_error(spark, market):
    params = spark.createDataFrame([tuple(PARAMS.values())], ", ".join(f"{k} double" for k in PARAMS))
    slots = risk.lock_slots(market["index"], market["targets"], CFG.lock_months)
    holed = market["cells"].where("not (variant = 'no_crisis' and target_idx = 1)")
    paths = spark.range(5).withColumnRenamed("id", "path")
    with pytest.raises(Exception, match="empty bootstrap pool"):
        risk.path_costs(paths, holed, slots, params, CFG).collect()


def test_summary_and_recommendation(spark, market):
    paths = run_paths(spark, market, 300, 4)
    summary = risk.risk_summary(paths)
    got = {(r.variant, r.strategy_id): r for r in summary.collect()}
    pdf = paths.toPandas()
    for (variant, sid), r in got.items():
        x = np.sort(pdf[(pdf.variant == variant) & (pdf.strategy_id == sid)].cost_eur.to_numpy())[::-1]
        assert (r.p5, r.p50, r.p95) == pytest.approx(tuple(np.percentile(x, [5, 50, 95])), rel=1e-9)
        assert r.cvar95 == pytest.approx(x[:15].mean(), rel=1e-9) and r.mean == pytest.approx(x.mean(), rel=1e-9)
    q = risk.recommendation(summary).first()
    base = {s: r for (v, s), r in got.items() if v == "unconditional"}
    assert q.cost_min_strategy == min(base, key=lambda s: base[s]["mean"])
    assert q.risk_averse_strategy == min(base, key=lambda s: base[s].p95)


def test_path_costs_come_from_stored_totals(spark):
    """The simulated years are walked once a session; each user reads their totals."""
    from wattlake.queries.feeds import Feeds

    feeds = Feeds(spark, "/nowhere")
    feeds.__dict__["path_totals"] = spark.createDataFrame([("full", 1, 10.0, 20.0, 30.0)], "variant string, path long, s1 double, s2 double, s3 double")
    got = {r.strategy_id: r.cost_eur for r in feeds.path_costs.collect()}
    assert got == pytest.approx({"S1": 10.0, "S2": 20.0, "S3": 30.0, "S4_30": 16.0, "S4_50": 20.0, "S4_70": 24.0})
