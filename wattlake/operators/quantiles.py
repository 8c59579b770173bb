"""Exact quantiles, moments and tail means of unbounded groups.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer, and a ranking window sorts the group on one task; both break when a
group is a large part of the data. Here a rank is looked for in buckets:

1. one aggregation gives count/mean/variance/min/max per (group, bucket) of a
   fixed monotone function - partial sums only, a few thousand buckets per group;
2. a running count over the buckets locates the one that holds each wanted rank;
3. while that bucket has over ``SMALL`` rows of different values, its rows are
   spread over ``SPLITS`` buckets between its own least and largest value, and
   counted again;
4. the rows of what is left, at most ``SMALL``, are collapsed to distinct values and ranked.

Each turn of 3 narrows the values by ``SPLITS``, so a few turns reach a single
value whatever the distribution. The result is exact: bucketing decides where
to look, never what is returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlake.session import stored_table

#: Buckets per factor e of magnitude: neighbours differ by 0.4 %.
BUCKETS_PER_E = 256
#: Buckets of a closer look, and rows of a bucket that need none.
SPLITS = 4096
SMALL = 65_536


def magnitude_bucket(value: Column) -> Column:
    """Monotone bucket number of a finite double."""
    scaled = F.log1p(F.abs(value)) * F.lit(float(BUCKETS_PER_E))
    return F.floor(F.signum(value) * scaled).cast("int")


def _at_rank(buckets: DataFrame, keys: Sequence[str], order: str, below: Column | int = 0) -> DataFrame:
    """Buckets ``(c, total)`` with the ranks ``first`` to ``last`` - 1 they hold and the sum ``later`` of all above."""
    ordered = Window.partitionBy(*keys).orderBy(order)
    upto = F.sum("c").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + below
    # Summed from the top: a frame up to the last row would be added up again for each row.
    falling = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    later = F.sum("total").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    return buckets.withColumns({"last": upto, "first": upto - F.col("c"), "later": F.coalesce(later, F.lit(0.0))})


def _values_of(base: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``base`` inside the buckets of ``targets``, with the target's columns."""
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    on.append((F.col("l.v") >= F.col("r.lo")) & (F.col("l.v") <= F.col("r.hi")))
    return base.alias("l").join(targets.alias("r"), on).select("r.*", "l.v")


def _found_ranks(base: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact value of each wanted rank and the sum of its bucket from that rank up, plus ``above``."""
    targets = stored_table(targets)
    carried = [*keys, "w", "rank", "below", "above"]
    while True:
        large = (F.col("lo") < F.col("hi")) & (F.col("c") > SMALL)
        open_ = targets.where(large)
        if open_.isEmpty():
            break
        part = F.least(F.lit(SPLITS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * SPLITS))
        finer = _values_of(base, open_.select(*carried, "lo", "hi"), keys).groupBy(*carried, part.alias("part")).agg(
            F.count("*").alias("c"), F.sum("v").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        finer = _at_rank(finer, [*keys, "w"], "part", F.col("below")).where("rank >= first AND rank < last")
        finer = finer.select(
            *keys, "w", "rank", F.col("first").alias("below"), (F.col("above") + F.col("later")).alias("above"), "c", "lo", "hi"
        )
        targets = stored_table(targets.where(~large).unionByName(finer))
    single = targets.where("lo = hi").select(
        *keys, "w", F.col("lo").alias("value"), (F.col("above") + (F.col("below") + F.col("c") - F.col("rank")) * F.col("lo")).alias("upper")
    )
    several = targets.where("lo < hi").select(*carried, "lo", "hi")
    distinct = _values_of(base, several, keys).groupBy(*carried, "v").agg(F.count("*").alias("c"))
    ranked = _at_rank(distinct.withColumn("total", F.col("v") * F.col("c")), [*keys, "w"], "v", F.col("below"))
    at = ranked.where("rank >= first AND rank < last").select(
        *keys, "w", F.col("v").alias("value"),
        (F.col("above") + F.col("later") + (F.col("last") - F.col("rank")) * F.col("v")).alias("upper"),
    )
    return single.unionByName(at)


def describe_groups(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float] | None = None,
    tail_share: float | None = None,
    tail_name: str = "tail_mean",
) -> DataFrame:
    """``keys, n, mean, std`` plus one column per quantile and the upper-tail mean.

    ``probs`` maps output column to probability (linear interpolation).
    ``tail_share`` asks for the mean of the ``ceil(share * n)`` largest values.
    """
    probs, grouped = probs or {}, list(keys)
    keys = grouped or ["_all"]
    base = (df if grouped else df.withColumn("_all", F.lit(0))).where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("v")
    )
    buckets = stored_table(
        base.groupBy(*keys, magnitude_bucket(F.col("v")).alias("b")).agg(
            F.count("*").alias("c"), F.avg("v").alias("a"), F.var_pop("v").alias("s2"), F.sum("v").alias("total"),
            F.min("v").alias("lo"), F.max("v").alias("hi"),
        )
    )
    group = Window.partitionBy(*keys)
    placed = buckets.withColumn("n", F.sum("c").over(group))
    placed = placed.withColumn("mean", F.sum(F.col("c") * F.col("a")).over(group) / F.col("n"))
    spread = F.col("c") * (F.col("s2") + F.pow(F.col("a") - F.col("mean"), F.lit(2.0)))
    moments = placed.groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum(spread).alias("m2"))

    position = lambda p: F.lit(p) * (F.col("n") - 1)
    tail_size = F.ceil(F.lit(tail_share or 0.0) * F.col("n"))
    ranks = {f"{name}_lo": F.floor(position(p)) for name, p in probs.items()}
    ranks |= {f"{name}_hi": F.ceil(position(p)) for name, p in probs.items()}
    if tail_share is not None:
        ranks["_tail"] = F.col("n") - tail_size
    out = moments
    if ranks:
        wanted = F.array(*[F.struct(F.lit(w).alias("w"), r.cast("bigint").alias("rank")) for w, r in ranks.items()])
        hits = F.filter(wanted, lambda x: (x["rank"] >= F.col("first")) & (x["rank"] < F.col("last")))
        targets = _at_rank(placed, keys, "b").select("*", F.explode(hits).alias("hit")).select(
            *keys, "hit.w", "hit.rank", F.col("first").alias("below"), F.col("later").alias("above"), "c", "lo", "hi"
        )
        found = _found_ranks(base, targets, keys)
        wide = found.groupBy(*keys).agg(
            *[F.max(F.when(F.col("w") == w, F.col("upper" if w == "_tail" else "value"))).alias(w) for w in ranks]
        )
        on = [F.col(f"m.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
        out = moments.alias("m").join(wide.alias("f"), on).select("m.*", *[F.col(f"f.{w}").alias(w) for w in ranks])
    cols: list[Column] = [F.col(k) for k in grouped]
    cols += [
        F.col("n"),
        F.col("mean"),
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"),
    ]
    for name, p in probs.items():
        fraction = position(p) - F.floor(position(p))
        step = F.col(f"{name}_hi") - F.col(f"{name}_lo")
        cols.append((F.col(f"{name}_lo") + step * fraction).alias(name))
    if tail_share is not None:
        cols.append((F.col("_tail") / tail_size).alias(tail_name))
    return out.select(*cols)


def group_mode(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value, smallest on ties, from (group, value) counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    smallest = F.min_by(F.col(value), F.struct(-F.col("c"), F.col(value)))
    return counts.groupBy(*keys).agg(smallest.alias(name))


#: Bins of one slice of a histogram's axis.
AXIS_SLICE = 1024


def histogram(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """Fixed-width bin counts per group, zero-filled between the overall first and last bin.

    Bins come from floor division; the axis runs between the bounds found in
    the counts themselves, never from the raw rows again. It is generated in
    slices, so one outlier makes the result long but needs no array of its length.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, F.floor(F.col(value) / F.lit(width)).cast("bigint").alias("bin")).agg(
        F.count("*").alias("n")
    )
    bounds = counts.agg(F.min("bin"), F.max("bin")).first()
    low, high = (0, 0) if bounds[0] is None else bounds
    slices = F.sequence(F.lit(low // AXIS_SLICE), F.lit(high // AXIS_SLICE))
    sliced = counts.select(*keys).distinct().select(*keys, F.explode(slices).alias("slice"))
    first = F.greatest(F.col("slice") * AXIS_SLICE, F.lit(low))
    last = F.least((F.col("slice") + 1) * AXIS_SLICE - 1, F.lit(high))
    full = sliced.select(*keys, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("bin"))
    return full.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", F.coalesce("n", F.lit(0)).alias("n")
    )
