"""Corpus pipeline: stages over ``documents``, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattlake.llm import exact_dedup, language_id, packing, simhash
from wattlake.llm.common import documents, stored
from wattlake.llm.queries import tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: those without text, without a letter or unlike every learned language."""
    return language_id.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text stays, the one with the largest id."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest id.

    Linked are texts whose SimHash fingerprints lie within two bits, found through the pivot tables as in ``op8``, and texts
    whose shingle sets are alike to 0.8, which lie further apart in bits.
    """
    return simhash.keep_one(docs, similarity=0.8, radius=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences of at most 2048 tokens.

    Python workers live through all stages, so this one remembers fewer words than the operator alone.
    """
    return packing.pack_documents(
        docs, tokenizer_file("word_bpe_49k.json"), capacity=2048, cached_words=50_000, cached_parts=80_000
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("packing", pack),
]

#: The stages use a tokenizer and trained models, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, applied to the whole ``documents`` table."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
