"""Generic data-quality checks: each returns the failing rows, empty means pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlake.functions.exprs import outside


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def null_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def out_of_range(
    df: DataFrame,
    column: str,
    low: float | None = None,
    high: float | None = None,
    inclusive: bool = True,
) -> DataFrame:
    return df.where(outside(F.col(column), low, high, inclusive))


def unaccepted_values(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """Distinct values outside the accepted list, with their row count."""
    bad = df.where(~F.col(column).isin(*values))
    return bad.groupBy(column).agg(F.count("*").alias("n_rows"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent (NULL keys are not checked)."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``check_id, n_failed, passed`` for many row rules in one pass over ``df``."""
    one = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    names = list(rules)
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    long = one.selectExpr(f"stack({len(names)}, {pairs}) as (check_id, n_failed)")
    return long.withColumn("passed", F.col("n_failed") == 0)


def gate_report(results: Sequence[DataFrame]) -> DataFrame:
    """One table ``check_id, n_failed, passed`` out of several check results."""
    out = results[0].select("check_id", "n_failed", "passed")
    for frame in results[1:]:
        out = out.unionByName(frame.select("check_id", "n_failed", "passed"))
    return out


class GateFailure(RuntimeError):
    """At least one gate failed; the message lists them all."""


def raise_if_failed(report: DataFrame) -> None:
    """Raise after every check ran, naming each failed one (the report has one row per check)."""
    failed = [
        f"{r.check_id} ({r.n_failed})"
        for r in report.where("not passed").orderBy("check_id").collect()
    ]
    if failed:
        raise GateFailure(", ".join(failed))


def failing_as_check(df: DataFrame, check_id: str) -> DataFrame:
    """Summarise a failing-rows frame to one report row."""
    return df.agg(F.count("*").alias("n_failed")).select(
        F.lit(check_id).alias("check_id"), "n_failed", (F.col("n_failed") == 0).alias("passed")
    )


def schema_differences(actual: T.StructType, expected: T.StructType) -> list[tuple[int, str, str]]:
    """``(position, expected, actual)`` for every column that differs in name, type or place."""
    out = []
    for i in range(max(len(actual), len(expected))):
        want = f"{expected[i].name} {expected[i].dataType.simpleString()}" if i < len(expected) else "absent"
        have = f"{actual[i].name} {actual[i].dataType.simpleString()}" if i < len(actual) else "absent"
        if want != have:
            out.append((i, want, have))
    return out


def assert_contract(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Return ``df`` unchanged, or raise listing every contract difference."""
    problems = schema_differences(df.schema, expected)
    if problems:
        raise ValueError("; ".join(f"column {i}: expected {w}, found {h}" for i, w, h in problems))
    return df
