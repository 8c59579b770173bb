"""Digests, checksums and partition-independent random draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw_word(seed: int, parts: Sequence[Column]) -> Column:
    """The first 32 bits of an md5 of the seed and the keys.

    The value depends on the keys alone, never on partitioning, task order or
    retries, so a lost executor recomputes the identical draw.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def word_index(word: Column, size: Column) -> Column:
    """Integer in ``[0, size)`` that a word draws."""
    return F.pmod(word, size.cast("bigint")).cast("int")


def uniform_index(seed: int, parts: Sequence[Column], size: Column) -> Column:
    """Uniform integer in ``[0, size)`` from the word of the seed and the keys."""
    return word_index(draw_word(seed, parts), size)


def row_digest(ts: Column, value: Column, decimals: int = 6) -> Column:
    """Canonical ``ISO-8601,value`` text of one hourly row."""
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.concat(stamp, F.lit(","), F.format_string(f"%.{decimals}f", value))


def series_checksum(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """sha256 of each group's canonical rows in time order.

    A group is one local year of one hourly series (at most 8,784 rows), so
    the collected array is bounded by the calendar, not by the data volume.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), row_digest(F.col(ts), F.col(value)).alias("r"))))
    text = F.array_join(F.transform(rows, lambda r: r["r"]), "\n")
    return df.groupBy(*keys).agg(F.sha2(text, 256).alias("sha256"))


def table_checksum(df: DataFrame, name: str) -> DataFrame:
    """One row ``(table_name, n_rows, checksum)``; order-insensitive, duplicates counted.

    The checksum adds up both 64-bit halves of every row's md5: partial sums per task and one
    tiny shuffle, no sort of the table.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns]
    digest = F.md5(F.concat_ws("\x1f", *cells))
    half = lambda at: F.conv(F.substring("d", at, 16), 16, 10).cast("decimal(38,0)")
    total = lambda at: F.coalesce(F.sum(half(at)), F.lit(0)).cast("string")
    return df.select(digest.alias("d")).agg(
        F.lit(name).alias("table_name"),
        F.count("*").alias("n_rows"),
        F.concat(total(1), F.lit(":"), total(17)).alias("checksum"),
    )
