"""Ranked lexical search over bag classes.

Documents are restricted to the terms of the items. What a score depends on is then the
vector of term counts and the length mark ``m``; documents that agree in both form
a class. Classes meet by a hash and are told apart by the vectors themselves, each
class is scored once, and its documents, by ascending id, take the places its score wins. A class
needs no more than its first ``top`` documents, which a window limit picks on the map side, so a class
with a third of all rows moves as few rows as another.

The items are a stated query set, taken in blocks of about ``block_terms`` distinct terms. A block's
vocabulary is what travels to the tasks, so its size is bounded whatever the number of items. A task holds the best
``top`` documents per item of the block and sends only those on.

Defined cases: a null text has no terms; a document without terms is not counted and never
found; a null id sorts after all others (ids lie below 2^63 - 1) and is returned as null; repeated documents are
documents of their own; an item without terms has no rows; rows that repeat an item's id and terms are one item; an item id with two texts
gives two rankings under that id; empty tables give an empty result; a text of any length is one bag of at most
the block's vocabulary; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattlake.llm.common import stored, text_of

#: Distinct terms of the items of a block, about; 200,000 terms are a few MB.
BLOCK_TERMS = 200_000
#: Ids that stand for null while rows are ranked.
NO_ID = (1 << 63) - 1
#: Cells (class, item) that are held at once.
CELLS = 1_000_000

#: Letters, digits and bytes from 128 on make terms; only A-Z change.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return text.translate(_TERM_BYTES).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item_id, terms, counts)`` of the different items that have terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(Counter(terms(t.as_py())).items()) for t in batch.column(1)]
            columns = [
                batch.column(0),
                pa.array([[t for t, _ in h] for h in held], pa.list_(pa.binary())),
                pa.array([[n for _, n in h] for h in held], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "terms", "counts"])

    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), text_of(text_col).cast("binary").alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"item_id {kind}, terms array<binary>, counts array<long>")
    return found.where(F.size("terms") > 0).distinct()


def bags(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, bag)``: all terms of a document, and its counts of the vocabulary as pairs of 32-bit numbers (term, count)."""
    place = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, found = [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                held = Counter(map(place.get, words))
                held.pop(None, None)
                lengths.append(len(words))
                found.append(np.array(sorted(held.items()), np.int32).tobytes())
            columns = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "bag"])

    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        text_of(text_col).cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, n long, bag binary")


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary: one sum per task and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            counts += np.bincount(flat[::2], minlength=size)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], ["term", "df"])

    found = rows.select("bag").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(size, np.int64)
    for row in found.collect():  # at most the block's vocabulary
        df[row["term"]] = row["df"]
    return df


def bag_classes(rows: DataFrame, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """``(bag, m, ids)``: classes of equal bags and marks with their first ``top`` documents in order."""
    # As a decimal, since the product may pass 64 bits.
    mark = F.expr(f"25L + CAST(75 AS DECIMAL(20,0)) * n * {n_docs}L div {n_terms}L")
    keyed = rows.where(F.length("bag") > 0).select("doc_id", "bag", mark.alias("m"))
    keyed = keyed.select(F.xxhash64("bag", "m").alias("hash"), "bag", "m", "doc_id")
    same = ("hash", "bag", "m")
    place = F.row_number().over(Window.partitionBy(*same).orderBy("doc_id"))
    first = keyed.withColumn("place", place).where(F.col("place") <= top)
    return first.groupBy(*same).agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).select("bag", "m", "ids")


class Postings:
    """Items of each term with the term's weight times its repeats in the item."""

    def __init__(self, block: list[tuple[list[int], list[int]]], weights: np.ndarray) -> None:
        term = np.concatenate([np.array(t, np.int64) for t, _ in block])
        item = np.repeat(np.arange(len(block)), [len(t) for t, _ in block])
        gain = weights[term] * np.concatenate([np.array(n, np.int64) for _, n in block])
        order = np.argsort(term, kind="stable")
        self.n_items = len(block)
        self.item, self.gain = item[order], gain[order]
        self.size = np.bincount(term, minlength=len(weights))
        self.start = np.cumsum(self.size) - self.size
        # A count's share of a score is at most 10^6; below 2^53 sums of doubles are exact.
        self.exact = int(np.bincount(item, gain).max()) < (1 << 53) // 1_000_000

    def scores(self, flat: np.ndarray, lengths: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Scores of classes (rows) for items (columns); ``flat`` holds the bags' (term, count) rows one after another."""
        term, tf = flat[:, 0], flat[:, 1].astype(np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        value = (1_000_000_000 * tf) // (1000 * tf + 8 * m[owner])
        repeats = self.size[term]
        ends = np.cumsum(repeats)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[term] - ends + repeats, repeats)
        cell = np.repeat(owner * self.n_items, repeats) + self.item[at]
        share = np.repeat(value, repeats) * self.gain[at]
        n_cells = len(lengths) * self.n_items
        if self.exact:
            return np.bincount(cell, share, n_cells).astype(np.int64).reshape(-1, self.n_items)
        total = np.zeros(n_cells, np.int64)
        np.add.at(total, cell, share)
        return total.reshape(-1, self.n_items)


class Best:
    """The ``top`` best documents of each item: highest score first, then smallest id."""

    def __init__(self, n_items: int, top: int) -> None:
        self.top = top
        self.least = np.ones(n_items, np.int64)  # a score of 0 wins no place
        self.item, self.score, self.doc = (np.empty(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """``ids`` holds the documents of the classes one after another, ``sizes`` how many each has."""
        owner, item = np.nonzero(scores >= self.least)
        repeats = sizes[owner]
        ends, starts = np.cumsum(repeats), np.cumsum(sizes) - sizes
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[owner] - ends + repeats, repeats)
        item = np.concatenate([self.item, np.repeat(item, repeats)])
        score = np.concatenate([self.score, np.repeat(scores[scores >= self.least], repeats)])
        doc = np.concatenate([self.doc, ids[at]])
        order = np.lexsort((doc, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        order = order[np.arange(len(item)) - first < self.top]
        item = item[np.arange(len(item)) - first < self.top]
        self.item, self.score, self.doc = item, score[order], doc[order]
        full = np.bincount(item, minlength=len(self.least)) == self.top
        last = np.searchsorted(item, np.flatnonzero(full), "right") - 1
        self.least[full] = self.score[last]


def _slices(bags_: list[bytes], postings: Postings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of classes of at most ``CELLS`` cells and postings each, or of one class."""
    lengths = np.array([len(b) // 8 for b in bags_])
    flat = np.frombuffer(b"".join(bags_), np.int32).reshape(-1, 2)
    ends = np.cumsum(lengths)
    work = np.concatenate([[0], np.cumsum(postings.size[flat[:, 0]])])[ends]
    at = 0
    while at < len(bags_):
        before = work[at - 1] if at else 0
        to = int(np.searchsorted(work, before + CELLS, "right"))
        to = max(at + 1, min(to, at + max(1, CELLS // postings.n_items)))
        yield at, to, flat[ends[at] - lengths[at] : ends[to - 1]], lengths[at:to]
        at = to


def _ranked_block(rows: DataFrame, block: list, vocabulary: list[bytes], item_kind: str, top: int) -> DataFrame | None:
    """``(item, item_id, doc_id, score)``: the best documents of each item of a block; None where nothing can be found."""
    counted = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = counted[0], counted[1] or 0
    if not n_docs:
        return None
    df = document_frequencies(rows, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    place = {t: i for i, t in enumerate(vocabulary)}
    postings = Postings([([place[bytes(t)] for t in row["terms"]], row["counts"]) for row in block], weights)
    names = [row["item_id"] for row in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(postings.n_items, top)
        for batch in batches:
            found, m = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ids = [np.array(i, np.int64) for i in batch.column(2).to_pylist()]
            for at, to, flat, lengths in _slices(found, postings):
                sizes = np.array([len(i) for i in ids[at:to]])
                best.add(postings.scores(flat, lengths, m[at:to]), np.concatenate(ids[at:to]), sizes)
        own = pa.array([names[i] for i in best.item], schema_kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), own, pa.array(best.doc), pa.array(best.score)], ["item", "item_id", "doc_id", "score"]
        )

    schema_kind = _arrow_kind(rows, item_kind)
    return bag_classes(rows, n_docs, n_terms, top).mapInArrow(run, f"item long, item_id {item_kind}, doc_id long, score long")


def _arrow_kind(rows: DataFrame, kind: str) -> pa.DataType:
    return rows.sparkSession.createDataFrame([], f"item_id {kind}").toArrow().schema.field(0).type


def search(
    docs: DataFrame, items: DataFrame, top: int = 10, doc_id: str = "doc_id", doc_text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best documents of each item with a score above 0."""
    queries = stored(item_terms(items, item_id, item_text))
    item_kind = queries.schema["item_id"].dataType.simpleString()
    total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_terms))
    found = None
    for number in range(n_blocks):
        block = queries.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(n_blocks)) == number).collect()
        if not block:
            continue
        vocabulary = sorted({bytes(t) for row in block for t in row["terms"]})
        rows = stored(bags(docs, vocabulary, doc_id, doc_text))
        part = _ranked_block(rows, block, vocabulary, item_kind, top)
        if part is None:
            break
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        part = part.withColumn("rank", place).where(F.col("rank") <= top)
        part = part.select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id long, score long")
    return found
