"""Operators against brute force on small fixtures."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlake.functions import text
from wattlake.functions.exprs import heating_degrees, outside
from wattlake.operators import checks, dedup, joins, quantiles, series, stats


def groups(seed=3):
    rng = random.Random(seed)
    hot = [("hot", rng.choice([12.5, rng.uniform(-50, 4000)])) for _ in range(3000)]
    cold = [(f"k{i % 7}", rng.gauss(0, 5)) for i in range(700)]
    return hot + cold + [("one", 4.25), ("flat", 1.0), ("flat", 1.0), ("zero", 0.0), ("zero", -0.0)]


@pytest.mark.parametrize("share", [0.05, 0.2, 1.0])
def test_describe_groups_equals_numpy(spark, share):
    rows = groups()
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    out = quantiles.describe_groups(df, ["k"], "v", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, tail_share=share)
    got = {r.k: r for r in out.collect()}
    assert set(got) == {k for k, _ in rows}
    for key, r in got.items():
        x = np.array([v for k, v in rows if k == key])
        tail = np.sort(x)[::-1][: math.ceil(share * len(x))]
        assert r.n == len(x)
        assert r.mean == pytest.approx(x.mean(), rel=1e-9, abs=1e-9)
        assert (r.p5, r.p50, r.p95) == pytest.approx(tuple(np.percentile(x, [5, 50, 95])), rel=1e-9, abs=1e-9)
        assert r.tail_mean == pytest.approx(tail.mean(), rel=1e-9, abs=1e-9)
        if len(x) > 1:
            assert r.std == pytest.approx(x.std(ddof=1), rel=1e-7, abs=1e-9)
        else:
            assert r.std is None


def test_describe_groups_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "k string, v double")
    got = {r.k: r.m for r in quantiles.describe_groups(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {None: 2.0, "a": 2.0}


@pytest.mark.parametrize("spread", [0.0, 1e-3])
def test_quantiles_of_a_million_rows_around_one_value(spark, spread):
    """The first bucket holds every row; it is split by value, or known to be one value."""
    n = 1_000_000
    df = spark.range(n).select((F.lit(5000.0) * (1 + spread * F.pmod(F.col("id") * 7919, F.lit(n)) / n)).alias("v"))
    r = quantiles.describe_groups(df, [], "v", {"p5": 0.05, "p50": 0.5}, tail_share=0.05).first()
    x = np.sort(5000.0 * (1 + spread * np.arange(n) / n))
    assert r.n == n
    assert (r.p5, r.p50) == pytest.approx(tuple(np.percentile(x, [5, 50])), rel=1e-12)
    assert r.tail_mean == pytest.approx(x[-n // 20:].mean(), rel=1e-9)


def test_sums_above_a_rank_are_carried_and_not_added_up_again(spark):
    df = spark.createDataFrame([("a", i, 1, float(i)) for i in range(5)] + [("b", 0, 2, 7.0)], "k string, b int, c long, total double")
    ranked = quantiles._at_rank(df, ["k"], "b")
    assert {(r.k, r.b): (r.first, r.last, r.later) for r in ranked.collect()} == {
        ("a", 0): (0, 1, 10.0), ("a", 1): (1, 2, 9.0), ("a", 2): (2, 3, 7.0), ("a", 3): (3, 4, 4.0), ("a", 4): (4, 5, 0.0), ("b", 0): (0, 2, 0.0)}
    assert "unboundedfollowing" not in ranked._jdf.queryExecution().toString().lower()


def test_ranks_never_sort_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 20)
    rng = random.Random(3)
    rows = [("a", 100.0 + rng.choice([0.0, rng.random() / 50])) for _ in range(4000)] + [("b", rng.gauss(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v double")
    for r in quantiles.describe_groups(df, ["k"], "v", {"m": 0.5, "top": 1.0}, tail_share=0.1).collect():
        x = np.sort([v for k, v in rows if k == r.k])
        assert (r.m, r.top) == pytest.approx((np.median(x), x[-1]), rel=1e-12)
        assert r.tail_mean == pytest.approx(x[-math.ceil(0.1 * len(x)):].mean(), rel=1e-9)


def test_histogram_of_an_outlier_needs_no_long_array(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 3_000_000.5), ("b", -1.5)], "k string, v double")
    bins = quantiles.histogram(df, ["k"], "v", 1.0)
    assert bins.count() == 2 * 3_000_003 and bins.agg(F.sum("n")).first()[0] == 3
    assert quantiles.histogram(df.where("v is null"), ["k"], "v", 1.0).count() == 0


def test_magnitude_bucket_is_monotone(spark):
    values = sorted(random.Random(1).uniform(-1e6, 1e6) for _ in range(500)) + [1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(quantiles.magnitude_bucket(F.col("v")).alias("b"))
    buckets = [r.b for r in df.collect()]
    assert buckets == sorted(buckets)


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c"), (2, "a"), (3, None)], "k int, v string")
    assert {r.k: r["mode"] for r in quantiles.group_mode(df, ["k"], "v").collect()} == {1: "a", 2: "c"}


def test_histogram_is_zero_filled(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 3.2), ("b", -1.0)], "k string, v double")
    got = {(r.k, r.bin): r.n for r in quantiles.histogram(df, ["k"], "v", 1.0).collect()}
    assert got == {(k, b): int((k, b) in {("a", 0), ("a", 3), ("b", -1)}) for k in "ab" for b in range(-1, 4)}


def test_copies_of_a_price_version_are_hashed_before_any_sort(spark):
    from wattlake.plans.staging import native_prices

    at = "2020-01-01 00:00:00"
    copies = [("AT", at, "PT60M", "2020-01-02T00:00:00+00:00", p) for p in (None, 5.0, 3.0)] * 50
    older = [("AT", at, "PT15M", "2020-01-01T00:00:00+00:00", 1.0), ("DE_LU", at, "PT60M", "2020-01-01T00:00:00+00:00", None)]
    df = spark.createDataFrame(copies + older, "zone string, t string, resolution string, ingested_at_utc string, price_eur_mwh double")
    kept = native_prices(df.withColumn("ts_utc", F.to_timestamp("t")))
    assert {(r.zone, r.resolution, r.price_eur_mwh) for r in kept.collect()} == {("AT", "PT60M", 3.0), ("DE_LU", "PT60M", None)}
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert "partial_min(price_eur_mwh" in plan and plan.index("partial_min(price_eur_mwh") > plan.index("SortAggregate")


def test_latest_wins_order_and_hot_key(spark):
    rows = [(1, "2024-01-02T00:00:00+00:00", "PT60M", 5.0), (1, "2024-01-02T00:00:00+00:00", "PT15M", 7.0),
            (1, "2024-01-01T23:00:00+00:00", "PT15M", 1.0), (2, "2024-01-01T00:00:00+00:00", "PT15M", 2.0)]
    rows += [(9, f"2024-02-{d:02d}T00:00:00+00:00", "PT60M", float(i)) for i in range(200) for d in (1, 2)]
    df = spark.createDataFrame(rows, "k int, at string, resolution string, v double").repartition(4)
    got = {r.k: (r.resolution, r.v) for r in dedup.latest_wins(df, ["k"], "at", ["resolution", "v"]).collect()}
    assert got == {1: ("PT15M", 7.0), 2: ("PT15M", 2.0), 9: ("PT60M", 0.0)}


def test_refetched_rows(spark):
    rows = [(0, "a", 1), (0, "a", 1), (1, "a", 1), (1, "a", 2), (2, "b", 1), (3, "b", 1)]
    df = spark.createDataFrame(rows, "response int, k string, v int")
    got = sorted((r.response, r.k, r.v) for r in dedup.drop_refetched(df, "response", ["k", "v"]).collect())
    assert got == [(0, "a", 1), (0, "a", 1), (1, "a", 2), (2, "b", 1)]


def test_duplicate_surplus(spark):
    df = spark.createDataFrame([("z", 1)] * 4 + [("z", 2)] + [("y", 3)] * 2, "zone string, ts int")
    got = {r.zone: r.n_duplicates for r in dedup.duplicate_surplus(df, ["zone", "ts"], ["zone"]).collect()}
    assert got == {"z": 3, "y": 1}


def test_rolling_std_needs_all_rows(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(40)], "i int, v double")
    got = [r.realized_vol for r in series.rolling_std(df, [], "i", "v").orderBy("i").collect()]
    assert got[:29] == [None] * 29
    assert got[29] == pytest.approx(np.std([i * i for i in range(30)], ddof=1))


def test_one_to_one_rejects_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 2.0)], "k int, w double")
    with pytest.raises(ValueError, match="left side"):
        joins.one_to_one(a, b, ["k"])
    assert joins.one_to_one(b, b.withColumnRenamed("w", "u"), ["k"]).count() == 1
    assert joins.one_to_one(a, b, ["k"], within=["v"]).count() == 2
    with pytest.raises(ValueError, match="left side"):
        joins.one_to_one(a.union(a), b, ["k"], within=["v"])


def test_reconcile_reports_each_difference(spark):
    a = spark.createDataFrame([("2020-01", "1.0 "), ("2020-02", "2"), ("2020-03", "3")], "m string, v string")
    b = spark.createDataFrame([("2020-01", "1.0"), ("2020-02", "2.5"), ("2020-04", "4")], "m string, v string")
    got = {r.m: r.status for r in joins.reconcile(a, b, ["m"], ["v"]).collect()}
    assert got == {"2020-02": "value_mismatch", "2020-03": "only_first", "2020-04": "only_second"}


def test_degree_days_stay_null_without_temperature(spark):
    df = spark.createDataFrame([(None,), (20.0,), (5.0,)], "t double").select(heating_degrees(F.col("t")).alias("h"))
    assert [r.h for r in df.collect()] == [None, 0.0, 13.0]


def test_range_needs_a_bound():
    with pytest.raises(ValueError, match="at least one bound"):
        outside(F.lit(1))


def test_gate_report_raises_with_all_names(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "v int")
    report = checks.violation_counts(df, {"low": F.col("v") < 2, "high": F.col("v") > 100, "mid": F.col("v") == 5})
    with pytest.raises(checks.GateFailure, match=r"low \(1\), mid \(1\)"):
        checks.raise_if_failed(report)
    checks.raise_if_failed(report.where("check_id = 'high'"))


def test_contract_difference():
    want = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])
    have = T.StructType([T.StructField("a", T.LongType())])
    assert [d[0] for d in checks.schema_differences(have, want)] == [0, 1]


def test_ols_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    n = 400
    x1, x2, m = rng.normal(size=n), rng.integers(0, 2, n).astype(float), rng.integers(1, 13, n)
    y = 3.0 * x1 - 2.0 * x2 + m * 0.7 + rng.normal(size=n) * (1 + x2)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, x1, x2, m)], "y double, x1 double, x2 double, m double")
    got = {r.term: r for r in stats.ols_fixed_effects(df, "y", ["x1", "x2"], "m").collect()}
    design = np.column_stack([x1, x2] + [(m == k).astype(float) for k in np.unique(m)])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    e = y - design @ beta
    inv = np.linalg.inv(design.T @ design)
    cov = inv @ (design.T * e**2) @ design @ inv * n / (n - design.shape[1])
    for i, term in enumerate(("x1", "x2")):
        assert got[term].estimate == pytest.approx(beta[i], rel=1e-8)
        assert got[term].std_error == pytest.approx(math.sqrt(cov[i, i]), rel=1e-8)
    assert got["x1"].r_squared == pytest.approx(1 - (e @ e) / ((y - y.mean()) ** 2).sum(), rel=1e-9)


def test_regimes_recover_planted_volatility(spark):
    rng = np.random.default_rng(1)
    rows = []
    for name in ("a", "b"):
        sigma = np.repeat([1.0, 6.0, 40.0], 300)
        day = datetime(2020, 1, 1)
        rows += [(name, day + timedelta(days=i), float(v), float(s)) for i, (v, s) in enumerate(zip(rng.normal(size=900) * sigma, sigma))]
    df = spark.createDataFrame(rows, "series string, day timestamp, d double, sigma double")
    first = stats.volatility_regimes(df, ["series"], "d").select("series", "day", "d", "regime")
    got = {(r.series, r.regime): r.a for r in first.groupBy("series", "regime").agg(F.avg(F.abs("d")).alias("a")).collect()}
    for s in ("a", "b"):
        assert got[(s, "calm")] < got[(s, "elevated")] < got[(s, "crisis")]
    again = stats.volatility_regimes(df.repartition(7), ["series"], "d").select("series", "day", "d", "regime")
    assert first.exceptAll(again).count() == 0


def test_garch_prefers_the_generating_parameters(spark):
    rng = np.random.default_rng(2)
    h, e, rows = 1.0, 0.0, []
    for i in range(3000):
        h = 0.05 + 0.15 * e * e + 0.8 * h
        e = math.sqrt(h) * rng.normal()
        rows.append(("s", i, e))
    df = spark.createDataFrame(rows, "k string, i int, d double")
    r = stats.garch_grid(df, ["k"], "i", "d", [0.05, 0.1, 0.15, 0.2], [0.5, 0.6, 0.7, 0.8, 0.9]).first()
    assert 0.1 <= r.alpha <= 0.2 and 0.7 <= r.beta <= 0.9 and r.persistence == pytest.approx(r.alpha + r.beta)


def test_number_literals_first_pattern_wins(spark):
    docs = spark.createDataFrame([
        (1, "cost € 12.3 M, then 1,234.50 EUR/MWh and €5 for 7 EUR"), (2, "share 45.6% over 8,766 hours, v1.2 and 2027-09 stay out"),
        (3, "€9 EUR/MWh"), (4, "no figures")], "id int, body string")
    got = sorted((r.doc_id, r.value, r.unit) for r in text.number_literals(docs, "id", "body").collect())
    assert got == [(1, 5.0, "EUR"), (1, 7.0, "EUR"), (1, 1234.5, "EUR/MWh"), (1, 12300000.0, "EUR"),
                   (2, 45.6, "%"), (2, 8766.0, "hours"), (3, 9.0, "EUR/MWh")]


def test_unmatched_literals_use_the_printed_precision(spark):
    docs = spark.createDataFrame([(1, "12.3 EUR"), (2, "12.4 EUR"), (3, "45 %")], "id int, body string")
    numbers = spark.createDataFrame([("12.345", "EUR"), ("0.449", "share"), ("S1", "strategy_id")], "value string, unit string")
    found = text.number_literals(docs, "id", "body")
    assert [r.doc_id for r in text.unmatched_literals(found, numbers).collect()] == [2]


def test_gaps_cross_hours_and_empty_hours(spark):
    base = datetime(2024, 1, 1)
    minutes = [0, 7, 59, 60, 185, 186, 186, 2000]
    rows = [("a", base + timedelta(minutes=m), i) for i, m in enumerate(minutes)] + [("b", base, 99)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int").repartition(3)
    got = {r.i: r.gap_minutes for r in series.gap_minutes(df, ["k"], "ts").collect()}
    assert got[0] is None and got[99] is None
    assert sorted(v for v in got.values() if v is not None) == sorted(float(b - a) for a, b in zip(minutes, minutes[1:]))
