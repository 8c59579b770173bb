"""Forward risk: targets, pool, cells, draws, path costs and their distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.config import HISTOGRAM_BIN_EUR
from wattlake.operators import quantiles
from wattlake.plans import risk
from wattlake.queries.feeds import Feeds
from wattlake.queries.registry import query


@query("r01_target_months", "SELECT * FROM targets")
def _(t: Feeds) -> DataFrame:
    return t.targets


@query("r02_bootstrap_pool", "SELECT * FROM pool")
def _(t: Feeds) -> DataFrame:
    return t.pool


@query("r03_price_cells", "SELECT * FROM cells", "spot_cost_eur:3 volume_mwh:5 oespi_base oespi_peak")
def _(t: Feeds) -> DataFrame:
    return t.cells


@query("r04_seeded_draws", "SELECT path, variant, target_idx, n_pool, pool_idx FROM draws")
def _(t: Feeds) -> DataFrame:
    return risk.draws(t.paths_in, t.cells, t.cfg.seed).select("path", "variant", "target_idx", "n_pool", "pool_idx")


@query("r05_path_lock_price", """
    SELECT variant, path, sum(volume_mwh * lock_price) AS locked_cost_eur FROM pathlock l
    JOIN (SELECT DISTINCT target_idx, delivery_year, volume_mwh FROM cells) v USING (delivery_year) GROUP BY 1, 2""", "locked_cost_eur:1")
def _(t: Feeds) -> DataFrame:
    locked = t.path_costs.where("strategy_id = 'S3'")
    return locked.select("variant", "path", F.col("cost_eur").alias("locked_cost_eur"))


@query("r06_path_costs", "SELECT * FROM pathcosts", "cost_eur:1")
def _(t: Feeds) -> DataFrame:
    return t.path_costs


@query("r07_risk_metrics", "SELECT * FROM risksum", "mean:1 std:1 p5:1 p50:1 p95:1 cvar95:1")
def _(t: Feeds) -> DataFrame:
    return t.risk_summary


@query("r07_risk_histogram", """
    WITH h AS (SELECT variant, strategy_id, floor(cost_eur / 100000.0::DOUBLE)::BIGINT AS bin, count(*) AS n FROM pathcosts GROUP BY 1, 2, 3),
         axis AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin FROM h)
    SELECT g.variant, g.strategy_id, axis.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT variant, strategy_id FROM h) g
    CROSS JOIN axis LEFT JOIN h ON h.variant = g.variant AND h.strategy_id = g.strategy_id AND h.bin = axis.bin""")
def _(t: Feeds) -> DataFrame:
    return quantiles.histogram(t.path_costs, ["variant", "strategy_id"], "cost_eur", HISTOGRAM_BIN_EUR)


@query("r08_variants", """
    SELECT variant, count(DISTINCT path) AS paths, count(DISTINCT strategy_id) AS strategies, avg(cost_eur) AS mean_cost FROM pathcosts GROUP BY 1""", "mean_cost:1")
def _(t: Feeds) -> DataFrame:
    return t.path_costs.groupBy("variant").agg(
        F.count_distinct("path").alias("paths"), F.count_distinct("strategy_id").alias("strategies"),
        F.avg("cost_eur").alias("mean_cost"))


@query("r09_recommendation", """
    WITH s AS (SELECT * FROM risksum WHERE variant = 'unconditional'),
         c AS (SELECT * FROM s ORDER BY mean, strategy_id LIMIT 1), r AS (SELECT * FROM s ORDER BY p95, strategy_id LIMIT 1)
    SELECT c.strategy_id AS cost_min_strategy, r.strategy_id AS risk_averse_strategy, r.mean - c.mean AS risk_premium_eur,
           c.p95 - r.p95 AS p95_reduction_eur FROM c, r""", "risk_premium_eur:1 p95_reduction_eur:1")
def _(t: Feeds) -> DataFrame:
    return risk.recommendation(t.risk_summary)


@query("r10_december_regime", "SELECT * FROM decregimes")
def _(t: Feeds) -> DataFrame:
    return risk.december_regimes(t.labelled)
