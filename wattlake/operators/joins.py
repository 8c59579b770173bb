"""Join shapes that need more than a plain ``DataFrame.join``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattlake.operators.checks import duplicate_keys


def with_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Attach each column of a one-row relation through a scalar subquery."""
    for name in bounds.columns:
        df = df.withColumn(name, bounds.select(name).scalar())
    return df


def one_to_one(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", within: Sequence[str] = ()
) -> DataFrame:
    """Join after proving that neither side repeats a key; the left side only inside each group of ``within``."""
    for side, frame, keys in (("left", left, [*within, *on]), ("right", right, list(on))):
        if duplicate_keys(frame, keys).limit(1).count():
            raise ValueError(f"{side} side of a one-to-one join repeats {keys}")
    return left.join(right, list(on), how)


def reconcile(
    first: DataFrame, second: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Differences between two transcriptions of the same table.

    A key in one entry only, or a value that differs after trimming, is one
    row; full agreement is an empty frame.
    """
    a = first.select(*keys, *[F.trim(F.col(v).cast("string")).alias(f"{v}_1") for v in values],
                     F.lit(True).alias("in_1"))
    b = second.select(*keys, *[F.trim(F.col(v).cast("string")).alias(f"{v}_2") for v in values],
                      F.lit(True).alias("in_2"))
    both = a.join(b, list(keys), "full_outer")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"{v}_1").eqNullSafe(F.col(f"{v}_2"))
    status = (
        F.when(F.col("in_2").isNull(), "only_first")
        .when(F.col("in_1").isNull(), "only_second")
        .when(differs, "value_mismatch")
    )
    cols = [c for v in values for c in (f"{v}_1", f"{v}_2")]
    return both.withColumn("status", status).where(F.col("status").isNotNull()).select(
        *keys, *cols, "status"
    )


def fill_in_order(df: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """Forward-fill then back-fill ``column`` along ``order``.

    Groups are one month of one series here (at most 745 hours).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = F.coalesce(
        F.last(column, ignorenulls=True).over(back), F.first(column, ignorenulls=True).over(ahead)
    )
    return df.withColumn(column, filled)
