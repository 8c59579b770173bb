"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlake.session import scratch_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """Text with null as the empty text."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the plan, fixes the rows against recomputation and survives lost
    executors. The schema is passed on, so an empty table reads back too.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
