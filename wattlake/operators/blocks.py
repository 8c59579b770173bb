"""Windows and recursions over one long series, block by block.

A window without bounds puts a whole series into one task. Here a series is cut into time blocks, which are the
tasks. What a block needs from before it is small: the last rows (a halo), a sum, a last value, or the state of a
recursion. It is taken from a table with one row per block, so the only window over a whole series runs over its blocks.

``block`` is a column that does not fall as the order rises, such as ``day_block``; blocks may be empty
or of any size. Rows with a null order come first and count as a block of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlake.session import stored_table

#: Days of a block of a daily series, and maps that are composed at once.
BLOCK_DAYS = 512
SPAN = 256


def day_block(order: str, days: int = BLOCK_DAYS) -> Column:
    return F.floor(F.datediff(F.col(order), F.lit("1970-01-01").cast("date")) / days)


def second_block(order: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(order)) / (seconds * 1_000_000))


def order_block(df: DataFrame, order: str, steps: int = BLOCK_DAYS) -> Column:
    """Block of ``steps`` days of a date or time, or of as many units of a number."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.DateType):
        return day_block(order, steps)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.datediff(F.to_date(order), F.lit("1970-01-01").cast("date")) / steps)
    return F.floor(F.col(order) / steps)


def _same(keys: Sequence[str], left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on ``keys`` where null equals null; the keys of the left side stay."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    matched = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, matched, how).drop(*[f"_r_{k}" for k in keys])


def _over_blocks(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_block")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "pos") -> DataFrame:
    """Place of each row in its series from 0, by ``order``."""
    keys = list(keys)
    rows = df.withColumn("_block", block)
    sizes = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(_over_blocks(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*keys, "_block", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    return _same([*keys, "_block"], rows, offsets).withColumn(name, F.col("_before") + place - 1).drop("_block", "_before")


def with_halo(df: DataFrame, keys: Sequence[str], order: str, rows: int, block: Column) -> DataFrame:
    """The rows with ``_block``, and before each block's own rows the last ``rows`` earlier ones, marked ``_halo``."""
    keys = list(keys)
    own = df.withColumn("_block", block)
    latest = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(F.col(order).desc()))
    last = own.withColumn("_place", latest).where(F.col("_place") <= rows)
    # At most ``rows`` rows of a block, and of its predecessors ``rows`` blocks that have any.
    tails = last.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c != order]))).alias("_tail"))
    before = F.flatten(F.collect_list("_tail").over(_over_blocks(keys).rowsBetween(-rows, -1)))
    halo = tails.select("_block", before.alias("_all")).where(F.size("_all") > 0).select(
        "_block", F.explode(F.slice("_all", F.greatest(F.size("_all") - rows + 1, F.lit(1)), F.lit(rows))).alias("_row")
    )
    halo = halo.select("_block", "_row.*")
    return own.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))


def differences(
    df: DataFrame, keys: Sequence[str], order: str, value: str, block: Column, rows: int, diff: str = "d_t", deviation: str = "realized_vol"
) -> DataFrame:
    """First difference and the sample deviation of the last ``rows`` differences, NULL until all are present."""
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    last = w.rowsBetween(-(rows - 1), Window.currentRow)
    moved = with_halo(df, keys, order, rows, block).withColumn(diff, F.col(value) - F.lag(value).over(w))
    full = F.count(diff).over(last) == rows
    told = moved.withColumn(deviation, F.when(full, F.stddev_samp(diff).over(last)))
    return told.where("not _halo").drop("_block", "_halo")


def from_previous(df: DataFrame, keys: Sequence[str], order: str, value: str, told: str, block: Column) -> DataFrame:
    """``told``: the value of the row before, NULL for the first row."""
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    rows = with_halo(df, keys, order, 1, block).withColumn(told, F.lag(value).over(w))
    return rows.where("not _halo").drop("_block", "_halo")


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, block: Column) -> DataFrame:
    """Sum of the values up to each row; NULL until there is one."""
    keys = list(keys)
    rows = df.withColumn("_block", block)
    sums = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    carried = F.sum("_sum").over(_over_blocks(keys).rowsBetween(Window.unboundedPreceding, -1))
    carry = sums.select(*keys, "_block", carried.alias("_carry"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    told = F.coalesce(F.col("_carry") + F.col("_inside"), F.col("_carry"), F.col("_inside"))
    joined = _same([*keys, "_block"], rows.withColumn("_inside", inside), carry)
    return joined.withColumn(name, told).drop("_block", "_carry", "_inside")


def filled(df: DataFrame, keys: Sequence[str], order: str, value: str, block: Column) -> DataFrame:
    """Gaps get the last value before them, gaps at the start the first value after them."""
    keys = list(keys)
    rows = df.withColumn("_block", block)
    ends = rows.groupBy(*keys, "_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(order))).alias("_last"),
        F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(order))).alias("_first"),
    )
    over = _over_blocks(keys)
    carry = ends.select(
        *keys, "_block",
        F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    rows = rows.withColumn("_back", F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_on", F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    joined = _same([*keys, "_block"], rows, carry)
    told = F.coalesce("_back", "_before", "_on", "_after")
    return joined.withColumn(value, told).drop("_block", "_back", "_on", "_before", "_after")


def index_to_first(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Series scaled so that its first non-NULL value is 100: one row per series is joined back."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias("_base"))
    return _same(list(keys), df, first).withColumn(name, F.lit(100.0) * F.col(value) / F.col("_base")).drop("_base")


def global_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "rank", count: str = "n") -> DataFrame:
    """Gapless rank from 1 in each group by ``order``, and the group's size.

    ``bucket`` rises with the order; each (group, bucket) is ranked by its own task and moved on by the rows of the buckets before.
    """
    keys = list(keys)
    rows = df.withColumn("_block", bucket)
    sizes = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        *keys, "_block",
        F.coalesce(F.sum("_n").over(_over_blocks(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(count),
    )
    place = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    joined = _same([*keys, "_block"], rows.withColumn("_place", place), offsets)
    return joined.withColumn(name, F.col("_before") + F.col("_place")).drop("_block", "_before", "_place")


def affine_starts(maps: DataFrame, keys: Sequence[str], pos: str, start: str) -> DataFrame:
    """``(*keys, pos, h)``: the state before each step of ``h -> a * h + b``, from ``start`` at place 0.

    ``maps`` holds ``a``, ``b``, the place ``pos`` from 0 without gaps, and ``start``. Affine maps compose: up to ``SPAN`` steps become one
    map, the states before those are found in the same way, and each run of steps is then walked from its own start.
    """
    keys = list(keys)
    step = F.struct(F.col(pos).alias("pos"), F.col("a").alias("a"), F.col("b").alias("b"))
    runs = maps.groupBy(*keys, F.floor(F.col(pos) / SPAN).alias("_run")).agg(F.array_sort(F.collect_list(step)).alias("steps"), F.first(start).alias(start))
    last = runs.agg(F.max("_run")).first()[0]
    if last:
        whole = F.aggregate(
            "steps", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")),
            lambda acc, s: F.struct((s["a"] * acc["a"]).alias("a"), (s["a"] * acc["b"] + s["b"]).alias("b")),
        )
        runs = stored_table(runs)
        upper = runs.select(*keys, "_run", start, whole.alias("m")).select(*keys, "_run", start, "m.a", "m.b")
        runs = _same([*keys, "_run"], runs, affine_starts(upper, keys, "_run", start))
    else:
        runs = runs.withColumn("h", F.col(start))
    none = F.array().cast("array<struct<pos:bigint,h:double>>")
    walked = F.aggregate(
        "steps", F.struct(F.col("h").cast("double").alias("h"), none.alias("out")),
        lambda acc, s: F.struct(
            (s["a"] * acc["h"] + s["b"]).alias("h"),
            F.concat(acc["out"], F.array(F.struct(s["pos"].cast("long").alias("pos"), acc["h"].alias("h")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return runs.select(*keys, F.explode(walked).alias("w")).select(*keys, F.col("w.pos").alias(pos), F.col("w.h").alias("h"))
