from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

@pytest.fixture()
def make(spark):
    """``documents`` rows from texts, stored as files; ids count from 0 unless given, further columns clash on purpose."""

    def build(tmp_path, texts, ids=None, langs=None, extra=()):
        ids = list(range(len(texts))) if ids is None else ids
        langs = ["en"] * len(texts) if langs is None else langs
        rows = [(i, t, lang, "src0", None) for i, t, lang in zip(ids, texts, langs, strict=True)]
        df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
        for name in extra:
            df = df.selectExpr("*", f"concat('own ', doc_id) AS `{name}`")
        path = str(tmp_path / "documents.parquet")
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return build
