"""Blocked windows and recursions against plain Python over the whole series."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattlake.operators import blocks, series, stats


def long_series(n, seed=1, gaps=0.0):
    rng = np.random.default_rng(seed)
    days = [date(1990, 1, 1) + timedelta(days=int(d)) for d in np.cumsum(rng.integers(1, 4, n))]
    values = [None if rng.random() < gaps else float(v) for v in rng.normal(0, 1, n)]
    return days, values


@pytest.fixture(scope="module")
def frame(spark):
    def make(gaps=0.0, n=700):
        rows = []
        for key, seed in (("a", 1), (None, 2)):
            rows += [(key, d, v) for d, v in zip(*long_series(n, seed, gaps), strict=True)]
        rows.append(("one", date(2000, 1, 1), 5.0))
        return spark.createDataFrame(rows, "k string, day date, v double").repartition(5)

    return make


def by_key(df, *names):
    out = {}
    for row in df.orderBy("day").collect():
        out.setdefault(row["k"], []).append(tuple(row[n] for n in names))
    return out


@pytest.mark.parametrize("days", [3, 40, 100_000])
def test_differences_and_deviation_over_block_ends(frame, days):
    df = frame()
    got = by_key(blocks.differences(df, ["k"], "day", "v", blocks.day_block("day", days), 30), "d_t", "realized_vol")
    for key, rows in by_key(df, "v").items():
        x = [r[0] for r in rows]
        d = [None] + [b - a for a, b in zip(x, x[1:], strict=False)]
        assert len(got[key]) == len(x)
        for i, (d_t, vol) in enumerate(got[key]):
            assert d_t == d[i]
            want = np.std(d[i - 29 : i + 1], ddof=1) if i >= 30 else None
            assert vol is None if want is None else vol == pytest.approx(want)


def test_differences_need_no_window_without_a_block(frame):
    plan = blocks.differences(frame(), [], "day", "v", blocks.day_block("day"), 30)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line and "collect_list" not in line]
    assert windows and all("_block" in line for line in windows)


@pytest.mark.parametrize("days", [1, 50, 100_000])
def test_running_total_fill_and_places(frame, days):
    df, block = frame(gaps=0.4), blocks.day_block("day", days)
    total = by_key(blocks.running_total(df, ["k"], ["day"], "v", "t", block), "t")
    fill = by_key(blocks.filled(df, ["k"], "day", "v", block), "v")
    place = by_key(blocks.numbered(df, ["k"], ["day"], block), "pos")
    base = by_key(blocks.index_to_first(df, ["k"], "day", "v", "i"), "i")
    before = by_key(blocks.from_previous(df, ["k"], "day", "v", "b", block), "b")
    for key, rows in by_key(df, "v").items():
        x = [r[0] for r in rows]
        known = [v for v in x if v is not None]
        running, last = None, None
        for i, v in enumerate(x):
            running = running if v is None else (running or 0.0) + v
            last = v if v is not None else last
            assert total[key][i][0] is None if running is None else total[key][i][0] == pytest.approx(running)
            assert fill[key][i][0] == (last if last is not None else known[0])
            assert place[key][i][0] == i
            assert base[key][i][0] is None if v is None else base[key][i][0] == pytest.approx(100 * v / known[0])
            assert before[key][i][0] == (x[i - 1] if i else None)


def test_affine_states_of_a_million_steps(spark):
    n = 1_000_000
    a, b = 0.999, F.pmod(F.xxhash64("pos"), F.lit(1000)) / 1000.0
    maps = spark.range(n).select(F.lit("s").alias("k"), F.col("id").alias("pos"), F.lit(a).alias("a"), F.lit(3.0).alias("start"))
    maps = maps.withColumn("b", b)
    got = blocks.affine_starts(maps, ["k"], "pos", "start")
    told = got.agg(F.count("*"), F.sum("h"), F.max_by("h", "pos")).first()
    h, total = 3.0, 0.0
    for (x,) in maps.select("pos", "b").orderBy("pos").select("b").toPandas().itertuples(index=False):
        total += h
        last, h = h, a * h + x
    assert told[0] == n and told[1] == pytest.approx(total, rel=1e-12) and told[2] == pytest.approx(last, rel=1e-12)


def test_garch_over_runs_equals_the_recursion(spark):
    days, values = long_series(1500, 5)
    values = [v * (1 + 3 * (i // 200 % 2)) for i, v in enumerate(values)]
    df = spark.createDataFrame([("a", d, v) for d, v in zip(days, values, strict=True)], "k string, day date, v double").repartition(7)
    got = stats.garch_grid(df, ["k"], "day", "v", (0.05, 0.1, 0.2), (0.6, 0.8, 0.9)).first()
    x = np.array(values)
    mu, var = x.mean(), x.var()
    best = None
    for alpha in (0.05, 0.1, 0.2):
        for beta in (0.6, 0.8, 0.9):
            if alpha + beta >= 1:
                continue
            h, ll = var, 0.0
            for v in x:
                ll -= 0.5 * (math.log(h) + (v - mu) ** 2 / h)
                h = var * (1 - alpha - beta) + alpha * (v - mu) ** 2 + beta * h
            best = max(best or (-math.inf,), (ll, alpha, beta, math.sqrt(h)))
    assert (got.alpha, got.beta, got.n_obs) == (best[1], best[2], 1500)
    assert got.log_likelihood == pytest.approx(best[0], rel=1e-12) and got.next_vol == pytest.approx(best[3], rel=1e-12)


def test_duration_curve_ranks_one_large_group_by_many_tasks(spark):
    rows = spark.range(300_000).select(
        F.lit(2020).alias("y"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_000)) / 7.0).alias("v"))
    curve = series.duration_curve(rows, ["y"], "v")
    told = curve.agg(F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.min("share_pct"), F.max("share_pct")).first()
    assert tuple(told) == (300_000, 300_000, 1, 300_000, 0.0, 100.0)
    w = Window.orderBy("rank")
    assert curve.withColumn("p", F.lag("v").over(w)).where("v > p").count() == 0
    plan = curve._jdf.queryExecution().executedPlan().toString()
    assert any("row_number" in line and "_block" in line for line in plan.splitlines())


def test_duration_curve_reads_one_set_of_cuts(spark, monkeypatch):
    """Approximate quantiles may come out differently each time they are computed, as on a cluster."""
    approx = F.percentile_approx

    def unsteady(value, bounds, accuracy):
        jitter = F.expr("cast(reflect('java.lang.Math', 'random') as double)")
        return F.transform(approx(value, bounds, accuracy), lambda c: c + 50 * jitter)

    monkeypatch.setattr(series.F, "percentile_approx", unsteady)
    rows = spark.range(20_000).select(F.lit(2020).alias("y"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    told = series.duration_curve(rows, ["y"], "v").select("rank", "v").collect()
    assert [r.v for r in sorted(told)] == sorted((r.v for r in told), reverse=True)
    assert sorted(r.rank for r in told) == list(range(1, 20_001))
