"""Quality classifier by compression with two dictionaries.

A zstandard dictionary is built from text labelled good and one from text labelled bad. Each text is
compressed in blocks with either; a text like the good ones comes out smaller with the good
dictionary. The difference of the two sizes per byte of text is the signal. A logistic function turns it into a
score: it also sees the size per byte itself and the length, because the same difference
says less in a short text, and a text that repeats itself is small with any dictionary. The
function is fitted to labelled rows that gave no text to the dictionaries, so it is calibrated on unseen text.

The fit takes a bounded sample: ``sample_docs`` labelled rows of each class, chosen by hash, half of them for the
dictionaries (``sample_blocks`` blocks of each class at most), half for the calibration. Scoring reads every text
whole, in one pass without a shuffle; its memory is that of a block.

Defined cases: a null text counts as the empty text; an empty text gets the share of label 1 in
the sample; a null label or id is not learned from; rows that repeat a label count once, a document with both labels is left out;
with labels of one class only, or none, every score is the share of label 1 (0.5 without labels); repeated rows are scored alike;
empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.llm.common import stored, text_of

#: Labelled rows of each class and blocks of each class that the fit takes at most.
SAMPLE_DOCS = 4000
SAMPLE_BLOCKS = 3000
#: Bytes that are compressed at once, so that the text itself does not replace the dictionary.
BLOCK_BYTES = 4096
DICTIONARY_BYTES = 262_144
LEVEL = 3
#: Weight of the penalty on the calibration's slopes, and its rounds.
RIDGE = 0.1
ROUNDS = 50


@dataclass(frozen=True)
class Model:
    """Dictionaries of both classes, calibration, and the share of label 1; no dictionaries without labels of both classes."""

    share: float
    good: bytes = b""
    bad: bytes = b""
    mean: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    slopes: tuple[float, ...] = ()

    @cached_property
    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return compressor(self.good), compressor(self.bad)

    def scores(self, sizes: np.ndarray) -> np.ndarray:
        """Scores of rows ``(bytes, size with the good, size with the bad dictionary)``."""
        if not self.slopes:
            return np.full(len(sizes), self.share)
        told = _sigmoid(with_one((signals(sizes) - self.mean) / self.spread) @ np.array(self.slopes))
        return np.where(sizes[:, 0] > 0, told, self.share)


def with_one(values: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(values)), values])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def blocks(text: bytes) -> list[bytes]:
    return [text[at : at + BLOCK_BYTES] for at in range(0, len(text), BLOCK_BYTES)]


def dictionary(samples: list[bytes]) -> bytes:
    """Dictionary of the samples: all of them where they fit, otherwise what zstandard selects."""
    whole = b"".join(samples)
    if len(whole) <= DICTIONARY_BYTES:
        return whole
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    """Compressor of bare frames with a dictionary; one that was not trained is taken as plain content."""
    content = zstandard.ZstdCompressionDict(data)
    content.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def sizes_of(text: bytes, model: Model) -> tuple[int, int, int]:
    """Bytes of a text, and its compressed size with the good and with the bad dictionary."""
    parts = blocks(text)
    good, bad = model.compressors
    return len(text), sum(len(good.compress(p)) for p in parts), sum(len(bad.compress(p)) for p in parts)


def signals(sizes: np.ndarray) -> np.ndarray:
    """Normalised size difference, size per byte and length, with their squares and products with the length."""
    n, good, bad = np.asarray(sizes, np.float64).reshape(-1, 3).T
    per_byte = 1 / np.maximum(n, 1)
    difference, ratio, length = (bad - good) * per_byte, good * per_byte, np.log1p(n)
    return np.column_stack([
        difference, ratio, length, difference * length, ratio * length, difference**2, ratio**2, length**2,
    ])


def calibrated(model: Model, sizes: np.ndarray, labels: np.ndarray) -> Model:
    """The model with a logistic function of the signals, by Newton's method with a penalty on the slopes."""
    found = signals(sizes)
    mean, spread = found.mean(0), found.std(0) + 1e-9
    rows = with_one((found - mean) / spread)
    penalty = RIDGE * np.diag([0.0] + [1.0] * (rows.shape[1] - 1))
    slopes = np.zeros(rows.shape[1])
    for _ in range(ROUNDS):
        told = _sigmoid(rows @ slopes)
        step = np.linalg.solve(
            (rows * (told * (1 - told))[:, None]).T @ rows + penalty + 1e-6 * np.eye(len(slopes)),
            rows.T @ (labels - told) - penalty @ slopes,
        )
        slopes = slopes + step * min(1.0, 3 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return Model(model.share, model.good, model.bad, tuple(mean), tuple(spread), tuple(slopes))


def fold(id_col: str = "doc_id", folds: int = 3) -> Column:
    """Remainder of the CRC-32 of the id as text."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """``(doc_id, label, text)`` of up to ``most`` labelled rows of each class: those with the smallest hash of the id.

    Only ids are joined with the labels; the texts are read once beside the chosen ids.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("label")).where("label in (0, 1)")
    one = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    here = stored(one.join(docs.select(F.col(f"`{id_col}`").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "label"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = here.where("label = 0").orderBy(*order).limit(most).unionByName(here.where("label = 1").orderBy(*order).limit(most))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    # At most 2 * most ids.
    return stored(texts.join(F.broadcast(stored(chosen)), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text"))


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, label, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            parts = blocks(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc] * len(parts), batch.column(0).type), pa.array([label] * len(parts), pa.int32()),
                 pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())],
                ["doc_id", "label", "number", "block"],
            )


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label",
    sample_docs: int = SAMPLE_DOCS, sample_blocks: int = SAMPLE_BLOCKS,
) -> Model:
    """Model of a bounded sample of the labelled rows; ``labels`` holds ``id_col`` and ``label_col`` (0 or 1)."""
    marks = labels.select(F.col(f"`{id_col}`"), F.col(f"`{label_col}`").alias("label"))
    sample = labelled_sample(docs, marks, id_col, text_col, sample_docs)
    counts = dict(sample.groupBy("label").count().collect())
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return Model(share)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    kind = sample.schema["doc_id"].dataType.simpleString()
    parts = stored(sample.where(half == 0).mapInArrow(_block_rows, f"doc_id {kind}, label int, number long, block binary"))
    order = F.xxhash64("doc_id", "number"), F.col("doc_id"), F.col("number")
    taken = [
        [bytes(row["block"]) for row in parts.where(F.col("label") == label).orderBy(*order).limit(sample_blocks).collect()]
        for label in (1, 0)
    ]
    model = Model(share, dictionary(taken[0]), dictionary(taken[1]))
    if not model.good or not model.bad:
        return Model(share)
    # At most 2 * sample_docs rows of four numbers.
    unseen = measured(sample.where(half == 1), model, ["label"]).toArrow().to_pydict()
    sizes = np.array([unseen["n_bytes"], unseen["good"], unseen["bad"]]).T
    marks_ = np.array(unseen["label"], np.float64)
    if len(set(unseen["label"])) < 2:
        return Model(share)
    return calibrated(model, sizes, marks_)


def measured(rows: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """The columns ``names`` of ``rows`` with ``(n_bytes, good, bad)`` of the binary column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([sizes_of(t.as_py(), model) for t in batch.column(len(names))], np.int64).reshape(-1, 3)
            columns = [*batch.columns[: len(names)], *[pa.array(c) for c in sizes.T]]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_bytes", "good", "bad"])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.select(*names, "text").mapInArrow(run, f"{kinds}, n_bytes long, good long, bad long")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row; the text is the only input of the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.slopes:
                sizes = np.array([sizes_of(t.as_py(), model) for t in batch.column(1)], np.int64).reshape(-1, 3)
            else:
                sizes = np.zeros((batch.num_rows, 3), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(sizes))], ["doc_id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double")
