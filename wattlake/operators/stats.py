"""Statistical fits built from aggregations.

Nothing here moves observations to the driver: only moment sums (k x k
numbers) or fitted parameters do.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.config import REGIME_LABELS
from wattlake.operators.blocks import SPAN, affine_starts, numbered, order_block
from wattlake.operators.quantiles import describe_groups
from wattlake.session import stored_table


def z_score(df: DataFrame, keys: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """Standardise with the population deviation of each group.

    Statistics are one small row per group, joined back: no window sorts or gathers a
    group, and adaptive execution broadcasts them if their measured bytes allow.
    """
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    scored = df.join(stats, list(keys))
    return scored.withColumn(name, (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def ols_fixed_effects(
    df: DataFrame, y: str, regressors: Sequence[str], effect: str
) -> DataFrame:
    """OLS of ``y`` on ``regressors`` with one fixed effect and HC1 errors.

    Returns ``term, estimate, std_error, ci_low, ci_high, n_obs, r_squared``.
    Two aggregations: the first gives the cross-moments of the variables
    demeaned per effect level, the second the residual-weighted moments of the
    sandwich. The k x k algebra (k = number of regressors) is numpy.
    """
    names = list(regressors)
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [y, *names, effect]))
    means = rows.groupBy(effect).agg(*[F.avg(c).alias(f"m_{c}") for c in [y, *names]])
    centred = rows.join(means, effect).select(
        effect, F.col(y).cast("double").alias("y0"),
        (F.col(y) - F.col(f"m_{y}")).alias("y"),
        *[(F.col(c) - F.col(f"m_{c}")).alias(f"x{i}") for i, c in enumerate(names)],
    )
    k = len(names)
    pairs = list(combinations_with_replacement(range(k), 2))
    first = centred.agg(
        F.count("*").alias("n"),
        F.count_distinct(effect).alias("levels"),
        F.var_pop("y0").alias("vy"),
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"xx{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"xy{i}") for i in range(k)],
    ).first()
    xx = np.zeros((k, k))
    for i, j in pairs:
        xx[i, j] = xx[j, i] = first[f"xx{i}_{j}"]
    beta = np.linalg.solve(xx, np.array([first[f"xy{i}"] for i in range(k)]))
    residual = F.col("y")
    for i in range(k):
        residual = residual - F.lit(float(beta[i])) * F.col(f"x{i}")
    second = centred.withColumn("e2", F.pow(residual, F.lit(2.0))).agg(
        F.sum("e2").alias("ssr"),
        *[F.sum(F.col("e2") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"m{i}_{j}") for i, j in pairs],
    ).first()
    meat = np.zeros((k, k))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = second[f"m{i}_{j}"]
    n, params = first["n"], k + first["levels"]
    inverse = np.linalg.inv(xx)
    cov = inverse @ meat @ inverse * (n / (n - params))
    se = np.sqrt(np.diag(cov))
    r2 = 1.0 - second["ssr"] / (first["vy"] * n)
    z95 = 1.959963984540054
    out = [
        (c, float(b), float(s), float(b - z95 * s), float(b + z95 * s), int(n), float(r2))
        for c, b, s in zip(names, beta, se, strict=True)
    ]
    return df.sparkSession.createDataFrame(
        out,
        "term string, estimate double, std_error double, ci_low double, ci_high double, "
        "n_obs bigint, r_squared double",
    )


#: Default grid of the volatility fit.
GARCH_ALPHAS = (0.02, 0.05, 0.1, 0.15, 0.2)
GARCH_BETAS = (0.5, 0.6, 0.7, 0.8, 0.9)


def garch_grid(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    alphas: Sequence[float],
    betas: Sequence[float],
    block: Column | None = None,
) -> DataFrame:
    """GARCH(1,1) by likelihood over a parameter grid, one fit per series.

    ``omega`` is variance-targeted, so ``(alpha, beta)`` is the whole search
    space. The variance of each step is an affine map of the one before, so a
    series is walked in runs of ``SPAN`` differences by many tasks: their maps
    compose, a short scan over the runs gives the variance that each begins with.
    ``block`` cuts the series for numbering its rows, by days or units of ``order`` unless given.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, order, F.col(value).alias("x"))
    moments = rows.groupBy(*keys).agg(F.avg("x").alias("mu"), F.var_pop("x").alias("v"), F.count("x").alias("n_obs"))
    placed = numbered(rows, keys, [order, "x"], order_block(rows, order) if block is None else block)
    taken = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"]).alias("xs")
    runs = placed.groupBy(*keys, F.floor(F.col("pos") / SPAN).alias("run")).agg(taken)
    grid = F.array(*[
        F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta"))
        for a in alphas for b in betas if a + b < 1.0
    ])
    points = runs.join(moments, keys).select("*", F.explode(grid).alias("g")).select("*", "g.alpha", "g.beta").drop("g")
    alpha, beta = F.col("alpha"), F.col("beta")
    omega = F.col("v") * (F.lit(1.0) - alpha - beta)
    points = stored_table(points.withColumn("omega", omega))

    def square(x: Column) -> Column:
        return (x - F.col("mu")) * (x - F.col("mu"))

    def following(h: Column, x: Column) -> Column:
        return F.col("omega") + alpha * square(x) + beta * h

    fit_keys = [*keys, "alpha", "beta"]
    whole = F.aggregate("xs", F.lit(0.0), following)
    maps = points.select(*fit_keys, "run", "v", F.pow(beta, F.size("xs")).alias("a"), whole.alias("b"))
    begun = points.join(affine_starts(maps, fit_keys, "run", "v"), [*fit_keys, "run"])

    def step(acc: Column, x: Column) -> Column:
        h = acc["h"]
        return F.struct(following(h, x).alias("h"), (acc["ll"] - F.lit(0.5) * (F.log(h) + square(x) / h)).alias("ll"))

    walked = begun.withColumn("walk", F.aggregate("xs", F.struct(F.col("h"), F.lit(0.0).alias("ll")), step))
    fitted = walked.groupBy(*fit_keys, "n_obs", "omega").agg(
        F.struct(F.sum("walk.ll").alias("ll"), F.max_by("walk.h", "run").alias("h")).alias("fit"))
    best = F.max_by(
        F.struct("n_obs", "alpha", "beta", "omega", F.col("fit.ll").alias("log_likelihood"),
                 F.sqrt("fit.h").alias("next_vol")),
        F.struct(F.col("fit.ll"), F.col("alpha"), F.col("beta")),
    )
    return fitted.groupBy(*keys).agg(best.alias("b")).select(
        *keys, "b.*", (F.col("b.alpha") + F.col("b.beta")).alias("persistence")
    )


#: Starts of the mixture: which quantiles are the means, and the variances, of standardised values.
STARTS = (
    ((0.5, 0.5, 0.5), (0.25, 1.0, 4.0)),
    ((1 / 6, 0.5, 5 / 6), (1.0, 1.0, 1.0)),
    ((0.25, 0.5, 0.75), (0.25, 0.5, 2.0)),
)
EM_ITERATIONS = 30
#: Iterations planned as one job before their parameters are written.
EM_PER_JOB = 6
VARIANCE_FLOOR = 1e-6


def _log_density(x: Column, weight: Column, mean: Column, variance: Column) -> Column:
    """Up to a constant that all components share."""
    return F.log(weight) - F.lit(0.5) * (F.log(variance) + F.pow(x - mean, F.lit(2.0)) / variance)


def _em_step(rows: DataFrame, params: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """One iteration for all series and restarts: partial sums of the responsibilities, one small row each."""
    joined = rows.join(params, list(keys))
    x = F.col(value)
    joined = joined.withColumns({f"l{i}": _log_density(x, F.col(f"w{i}"), F.col(f"m{i}"), F.col(f"v{i}")) for i in range(k)})
    joined = joined.withColumn("top", F.greatest(*[F.col(f"l{i}") for i in range(k)]))
    joined = joined.withColumns({f"p{i}": F.exp(F.col(f"l{i}") - F.col("top")) for i in range(k)})
    joined = joined.withColumn("all", sum((F.col(f"p{i}") for i in range(1, k)), F.col("p0")))
    share = [F.col(f"p{i}") / F.col("all") for i in range(k)]
    sums = joined.groupBy(*keys, "restart").agg(
        F.sum(F.col("top") + F.log("all")).alias("likelihood"),
        *[(F.sum(share[i]) + F.lit(1e-12)).alias(f"s{i}") for i in range(k)],
        *[F.sum(share[i] * x).alias(f"a{i}") for i in range(k)],
        *[F.sum(share[i] * x * x).alias(f"b{i}") for i in range(k)],
    )
    total = sum((F.col(f"s{i}") for i in range(1, k)), F.col("s0"))
    mean = [F.col(f"a{i}") / F.col(f"s{i}") for i in range(k)]
    return sums.select(
        *keys, "restart", "likelihood",
        *[(F.col(f"s{i}") / total).alias(f"w{i}") for i in range(k)],
        *[mean[i].alias(f"m{i}") for i in range(k)],
        *[
            (F.greatest(F.col(f"b{i}") / F.col(f"s{i}") - mean[i] * mean[i], F.lit(0.0)) + F.lit(VARIANCE_FLOOR)).alias(f"v{i}")
            for i in range(k)
        ],
    )


def fit_regimes(df: DataFrame, keys: Sequence[str], value: str, iterations: int = EM_ITERATIONS) -> DataFrame:
    """Three-component normal mixture per series by EM: ``keys, components, likelihood``.

    ``value`` is standardised. An iteration is one aggregation over the rows of all series and restarts;
    only parameters, one row per series and restart, travel back. Starts come from exact
    quantiles, so the fit is the same on every run. Components come sorted by variance.
    """
    keys = list(keys)
    k = len(STARTS[0][0])
    rows = stored_table(df.where(F.col(value).isNotNull()).select(*keys, value))
    probs = {f"q{i}": p for i, p in enumerate(sorted({p for means, _ in STARTS for p in means}))}
    name = {p: q for q, p in probs.items()}
    starts = F.array(*[
        F.struct(
            F.lit(r).alias("restart"),
            *[F.lit(1.0 / k).alias(f"w{i}") for i in range(k)],
            *[F.col(name[p]).alias(f"m{i}") for i, p in enumerate(means)],
            *[F.lit(v).alias(f"v{i}") for i, v in enumerate(variances)],
        )
        for r, (means, variances) in enumerate(STARTS)
    ])
    params = stored_table(describe_groups(rows, keys, value, probs).select(*keys, F.inline(starts)))
    for done in range(0, iterations, EM_PER_JOB):
        for _ in range(min(EM_PER_JOB, iterations - done)):
            params = _em_step(rows, params.drop("likelihood"), keys, value, k)
        params = stored_table(params)
    parts = F.array(*[F.struct(F.col(f"v{i}").alias("v"), F.col(f"m{i}").alias("m"), F.col(f"w{i}").alias("w")) for i in range(k)])
    best = F.max_by(F.struct(F.array_sort(parts).alias("components"), "likelihood"), F.struct("likelihood", -F.col("restart")))
    return params.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def volatility_regimes(df: DataFrame, keys: Sequence[str], value: str, labels: Sequence[str] = REGIME_LABELS) -> DataFrame:
    """Label each row with the most likely component of its series (calm first, by variance).

    Standardising uses each series' population deviation. Ties go to the calmer label.
    """
    keys = list(keys)
    scored = z_score(df.where(F.col(value).isNotNull()), keys, value, "_z")
    joined = scored.join(fit_regimes(scored, keys, "_z"), keys)
    density = F.transform("components", lambda c: _log_density(F.col("_z"), c["w"], c["m"], c["v"]))
    best = F.array_position(density, F.array_max(density))
    regime = F.element_at(F.array(*[F.lit(name) for name in labels]), best.cast("int"))
    return joined.withColumn("regime", regime).drop("_z", "components", "likelihood")
