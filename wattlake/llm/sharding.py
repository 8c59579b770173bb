"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

Drawing a shard for each row on its own gives uneven shards. Here the number of
rows that each file sends to each shard is drawn first, from the multivariate
hypergeometric law that a uniform shuffle of all rows would follow, so every
shard gets its exact size. Then each file's rows are permuted and dealt out by
that row of the matrix, exchanged once, and permuted again inside their shard.

Both permutations are keyed bijections of a row's position (a Feistel network
walked until it is in range). A row's shard and slot follow from its file and
its position in it, never from task boundaries or arrival order, so a retried
task deals the same rows to the same places and no shard is ever gathered:
slots are blocks of ``block_rows`` rows, dealt to many tasks.

The law is ``rows``: shard sizes differ by at most one row. Equal texts are
spread like any other rows; keeping them together would make sizes uneven.

Defined cases: null texts and ids are rows like any other; repeated rows have
positions of their own; an empty table gives an empty result; a column of
``docs`` named ``shard`` or ``slot`` is replaced, all others are kept. A table
that is not plain files, or of which rows are filtered, is stored first.
The matrix is drawn by halves: a set of files splits its share of every shard between its two halves. The driver
does so for at most ``GROUPS`` groups of files; each group's own files are drawn by a task and kept as a table, which is
broadcast up to ``BROADCAST_FILES`` files and joined beyond.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wattlake.llm.common import stored

#: Rows of one block of slots, a few MB of text.
BLOCK_ROWS = 1024
#: Groups of files that the driver draws for, and files of a group.
GROUPS, GROUP_FILES = 4096, 256
#: Files whose deals are broadcast: 400 bytes each with 24 shards.
BROADCAST_FILES = 50_000
#: From this population on numpy's sampler gives up.
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many good ones are among ``draws`` of a population of any size."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good + bad else 0
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    mean = draws * good // total
    spread = 40 * int(np.sqrt(draws * (good / total) * (bad / total)) + 1)
    low, high = max(low, mean - spread), min(high, mean + spread)
    k = np.arange(low, high, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], "right"))


def shard_sizes(n_rows: int, n_shards: int) -> np.ndarray:
    return n_rows // n_shards + (np.arange(n_shards) < n_rows % n_shards).astype(np.int64)


def _draw(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """``hypergeometric`` elementwise."""
    small = good + bad < NUMPY_LIMIT
    out = np.zeros(len(good), np.int64)
    out[small] = rng.hypergeometric(good[small], bad[small], draws[small])
    for i in np.flatnonzero(~small):
        out[i] = hypergeometric(rng, int(good[i]), int(bad[i]), int(draws[i]))
    return out


def split_rooms(file_rows: np.ndarray, room: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows from each file to each shard, of which they fill ``room`` exactly; halves of halves of the files."""
    width = 1 << max(len(file_rows) - 1, 0).bit_length()
    rows = np.zeros(width, np.int64)
    rows[: len(file_rows)] = file_rows
    share, size = np.asarray(room, np.int64)[None, :], width
    while size > 1:
        size //= 2
        left, rest = rows.reshape(-1, 2, size).sum(2)[:, 0], share.sum(1)
        first = np.zeros_like(share)
        for j in range(share.shape[1]):
            rest = rest - share[:, j]
            first[:, j] = _draw(rng, share[:, j], rest, left)
            left = left - first[:, j]
        share = np.stack([first, share - first], 1).reshape(-1, share.shape[1])
    return share[: len(file_rows)]


def communication_matrix(file_rows: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows from each file to each shard; rows and columns add up exactly."""
    return split_rooms(np.array(file_rows, np.int64), shard_sizes(sum(file_rows), n_shards), np.random.default_rng(seed))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(position: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed bijection of ``0 .. size - 1``, elementwise."""
    bits = np.ceil(np.log2(np.maximum(size, 2).astype(np.float64) + 1) / 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    value, key = position.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(value))
    while len(todo):
        v, b, m, k = value[todo], bits[todo], mask[todo], key[todo]
        left, right = v >> b, v & m
        for turn in range(6):
            left, right = right, left ^ (_mix(right + _mix(k + np.uint64(turn))) & m)
        value[todo] = (left << b) | right
        todo = todo[value[todo] >= size[todo].astype(np.uint64)]
    return value.astype(np.int64)


def _located(docs: DataFrame) -> DataFrame:
    meta = docs.metadataColumn("_metadata")
    return docs.select(
        F.struct("*").alias("row"), meta["file_path"].alias("file"), meta["row_index"].alias("position")
    )


def _files(rows: DataFrame) -> DataFrame:
    return stored(rows.groupBy("file").agg(F.count("*").alias("n"), F.max("position").alias("last")))


def deals(files: DataFrame, n_files: int, n_shards: int, seed: int, groups: int) -> tuple[DataFrame, list[int]]:
    """``(file, n, until, before)`` of every file, and the sizes of the shards.

    ``until`` are its rows up to and in each shard, ``before`` the rows of other files that come first in each shard.
    """
    files = files.select("file", "n", F.pmod(F.xxhash64("file"), F.lit(groups)).alias("group"))
    totals = np.zeros(groups, np.int64)
    for r in files.groupBy("group").agg(F.sum("n").alias("n")).collect():
        totals[r["group"]] = r["n"]
    matrix = communication_matrix(totals.tolist(), n_shards, seed)
    starts = matrix.cumsum(0) - matrix

    def deal(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found, group = found.sort_values("file"), int(key[0])
        mine = split_rooms(found["n"].to_numpy(), matrix[group], np.random.default_rng([seed, group]))
        before = mine.cumsum(0) - mine + starts[group]
        return pd.DataFrame(
            {"file": found["file"], "n": found["n"], "until": list(mine.cumsum(1)), "before": list(before)}
        )

    drawn = files.groupBy("group").applyInPandas(deal, "file string, n long, until array<long>, before array<long>")
    return stored(drawn), matrix.sum(0).tolist()


@F.pandas_udf(LongType())
def _permuted(position: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(position.to_numpy(), size.to_numpy(), _mix(key.to_numpy().astype(np.uint64))))


def shard(docs: DataFrame, n_shards: int, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, exchanged by blocks and in slot order inside each."""
    docs = docs.drop("shard", "slot")
    try:
        rows = _located(docs)
        files = _files(rows)
        whole = files.where("last + 1 <> n").isEmpty()
    except AnalysisException:
        whole = False
    if not whole:
        rows = _located(stored(docs))
        files = _files(rows)
    n_files = files.count()
    table, sizes = deals(files, n_files, n_shards, seed, min(GROUPS, n_files // GROUP_FILES + 1))
    table = F.broadcast(table) if n_files <= BROADCAST_FILES else table
    # Each step is used more than once by the next.
    placed = rows.join(table, "file").withColumn("mine", _permuted("position", "n", F.xxhash64("file", F.lit(seed))))
    placed = placed.withColumn("to", F.size(F.filter("until", lambda u: u <= F.col("mine"))))
    rank = F.col("mine") - F.when(F.col("to") > 0, F.get("until", F.col("to") - 1)).otherwise(0)
    place = F.get("before", F.col("to")) + rank
    size = F.get(F.lit(sizes).cast("array<long>"), F.col("to"))
    placed = placed.select("row", "to", _permuted(place, size, F.xxhash64("to", F.lit(seed + 1))).alias("slot_in"))
    return (
        placed.select("row.*", F.col("to").alias("shard"), F.col("slot_in").alias("slot"))
        .repartition("shard", F.floor(F.col("slot") / block_rows))
        .sortWithinPartitions("shard", "slot")
    )
