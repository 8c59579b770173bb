"""Exact deduplication with a heavy-hitter split.

A digest that a third of all rows share would meet in one task of an ordinary
shuffle. Misra-Gries summaries find every digest above ``1 / (counters + 1)`` of
the rows in one pass; their exact counts and winners (at most ``2 * counters + 1`` rows)
are broadcast, and rows of those digests are settled where they are read. The
remaining digests are each below that share and go through an ordinary shuffle.

Defined cases:

* a null text counts as the empty text; both form one group;
* of equal texts the row with the largest id stays; a null id loses to any
  other id;
* rows that repeat an id and its text are one document: they give one outcome
  row and all of them count in ``group_size``;
* an id with two different texts is two documents;
* an empty table gives an empty result; further columns, whatever their names,
  are passed through by ``keep_one`` and ignored by ``outcomes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.llm.common import stored, text_of

#: Digests above ``1 / (COUNTERS + 1)`` of all rows are settled by broadcast, at most twice as many.
COUNTERS = 1024


def digest_of(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def prune(counts: dict, counters: int) -> dict:
    """At most ``counters`` entries: subtract the largest count that has to go."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {key: n - cut for key, n in counts.items() if n > cut}


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[key] = counts.get(key, 0) + n
            counts = prune(counts, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"]
        )

    return run


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """A superset of the digests that hold over ``1 / (counters + 1)`` of ``copies``; at most ``2 * counters + 1`` rows.

    Each task returns one summary of ``2 * counters + 1`` counters, and equal digests of all summaries are
    added. A sum falls short of the true count by at most ``1 / (2 * counters + 2)`` of all rows, so it
    stays above that share for every digest wanted, and no more than ``2 * counters + 1`` can.
    """
    total = digests.agg(F.sum("copies")).first()[0] or 0
    found = (
        digests.select("digest", "copies")
        .mapInArrow(_summaries(2 * counters + 1), "digest binary, n long")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") * (2 * counters + 2) > total)
        .collect()
    )
    return digests.sparkSession.createDataFrame([(bytes(r["digest"]),) for r in found], "digest binary")


def _groups(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))


def winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Exact winner and size of each frequent digest; at most ``2 * counters + 1`` rows of about 50 bytes."""
    found = frequent_digests(digests, counters)
    return stored(_groups(digests.join(F.broadcast(found), "digest")).where("group_size > 1"))


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest, copies)``, one row per document, written once."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), digest_of(text_of(text_col)).alias("digest"))
    return stored(rows.groupBy("doc_id", "digest").agg(F.count("*").alias("copies")))


def outcomes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``(doc_id, digest, keep_id, group_size, kept)``, one row per document."""
    digests = narrow(docs, id_col, text_col)
    heavy = F.broadcast(winners(digests, counters))
    rest = digests.join(heavy, "digest", "left_anti")
    settled = digests.join(heavy, "digest").unionByName(rest.join(_groups(rest), "digest"))
    return settled.select(
        "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row of ``docs`` per distinct text, the one with the largest id, in the columns of ``docs``.

    Losing rows of frequent digests are dropped by the tasks that read them;
    the rest are shuffled once, with one candidate per digest and task.
    """
    heavy = F.broadcast(winners(narrow(docs, id_col, text_col), counters))
    rows = docs.select(
        F.struct("*").alias("row"), digest_of(text_of(text_col)).alias("digest"), F.col(f"`{id_col}`").alias("doc_id")
    )
    survivors = rows.join(heavy, "digest", "left").where(
        F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    )
    # The order is a struct, because a bare null would leave its group without a winner.
    return survivors.groupBy("digest").agg(F.max_by("row", F.struct("doc_id")).alias("row")).select("row.*")
