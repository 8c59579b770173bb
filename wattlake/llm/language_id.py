"""Language identification as inference over a mixture of languages.

Each language is a distribution over hashed byte trigrams, counted over all
training rows. A document is a mixture: expectation-maximisation estimates the
share of each language from the likelihoods of its trigrams. Which languages
take part is chosen by penalised likelihood: starting from the best single
language, the next one by share joins only if it raises the log-likelihood by
more than a penalty that grows with the log of the number of trigrams.

Counts are partial sums per task and language, so no text is shuffled, and the
model holds ``2 ** BITS`` numbers per language.

Defined cases: a null text, or one without letters, is ``und`` with score 0, as is
every text if no language was learned; rows without a language label are not
learned from; repeated rows count as often as they occur and give one row each;
ties go to the first language by name; texts of any length are read whole, and what
is held beside the text is bounded by the number of distinct trigrams; an empty table
gives an empty result; further columns are ignored by ``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.llm.common import text_of

BITS = 15
#: Pseudo-count of every trigram.
SMOOTHING = 0.5
#: A language joins if it gains this many times log(trigrams) of log-likelihood. Trigrams
#: overlap, so their evidence counts about threefold.
PENALTY = 3.0
ITERATIONS = 12
UNKNOWN = "und"
#: A text of so many trigrams or more is unlike every learned language if the mean log-likelihood of its trigrams lies below
#: this: a factor e below that of a model that has learned nothing.
LEAST_TRIGRAMS = 20
LEAST_FIT = -BITS * float(np.log(2)) - 1.0
#: Trigrams that are hashed at once, which bounds the memory for very long texts.
BLOCK = 1 << 19
LETTER = regex.compile(r"\p{L}")


def trigrams(data: bytes) -> np.ndarray:
    """Hashed trigrams of the bytes."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def blocks(text: str) -> Iterator[np.ndarray]:
    """Hashed trigrams of the lower-cased text, word ends included, ``BLOCK`` at a time."""
    data = f" {text.lower()} ".encode()
    for at in range(0, len(data) - 2, BLOCK):
        yield trigrams(data[at : at + BLOCK + 2])


def distinct(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed trigrams of the text and how often each occurs: at most ``2 ** BITS``, however long the text is."""
    if len(text) < BLOCK // 8:
        return np.unique(np.concatenate([*blocks(text), np.empty(0, np.int32)]), return_counts=True)
    n = sum(np.bincount(grams, minlength=1 << BITS) for grams in blocks(text))
    seen = np.flatnonzero(n)
    return seen, n[seen]


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages by name and their trigram probabilities, ``2 ** BITS`` x languages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in counts:
                    counts[lang] = np.zeros(1 << BITS, np.int64)
                grams, n = distinct(text)
                counts[lang][grams] += n
        for lang, n in counts.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen)), pa.array(seen, pa.int32()), pa.array(n[seen])], ["lang", "gram", "n"]
            )

    labelled = rows.select(text_of(text_col).alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("lang IS NOT NULL")
    found = (
        labelled.mapInArrow(count, "lang string, gram int, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    langs = sorted(set(found["lang"].to_pylist()))
    table = np.full((1 << BITS, len(langs)), SMOOTHING)
    if langs:
        at = np.searchsorted(np.array(langs), np.array(found["lang"].to_pylist()))
        np.add.at(table, (found["gram"].to_numpy(), at), found["n"].to_numpy())
        table /= table.sum(0)
    return langs, table


def mixture(p: np.ndarray, times: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares that maximise the likelihood of trigrams with probabilities ``p`` that occur ``times`` each, and its logarithm."""
    n = times.sum()
    for _ in range(ITERATIONS):
        now = share * (p.T @ (times / (p @ share))) / n
        if np.abs(now - share).max() < 1e-3:
            share = now
            break
        share = now
    return share, float(times @ np.log(p @ share))


def infer(text: str, table: np.ndarray) -> tuple[np.ndarray, float]:
    """Share of each language after selection of the language set, and the mean log-likelihood of a trigram."""
    grams, times = distinct(text)
    p, n, k = table[grams], times.sum(), table.shape[1]
    single = times @ np.log(p)
    best = int(single.argmax())
    chosen, score = [best], float(single[best])
    share = np.zeros(k)
    share[best] = 1.0
    if k > 1:
        all_shares, _ = mixture(p, times, np.full(k, 1.0 / k))
        penalty = PENALTY * np.log(n)
        for extra in np.argsort(-all_shares, kind="stable"):
            if extra in chosen:
                continue
            wider = [*chosen, int(extra)]
            weights, likelihood = mixture(p[:, wider], times, np.maximum(all_shares[wider], 1e-3) / np.maximum(all_shares[wider], 1e-3).sum())
            if likelihood - score <= penalty:
                break
            chosen, score = wider, likelihood
            share = np.zeros(k)
            share[chosen] = weights
    return share, score / n


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> Column:
    """Column ``struct(lang, score, fit)`` from the text alone.

    ``fit`` is the mean log-likelihood of a trigram: minus infinity without a letter, null if the
    text is too short to tell or no language was learned.
    """
    langs, table = model
    sent = docs.sparkSession.sparkContext.broadcast((langs, table))

    @F.arrow_udf("lang string, score double, fit double")
    def run(texts: pa.Array) -> pa.Array:
        names, probabilities = sent.value
        out_lang, out_score, out_fit = [], [], []
        for text in texts.to_pylist():
            letter = LETTER.search(text)
            if not names or not letter:
                out_lang.append(UNKNOWN)
                out_score.append(0.0)
                out_fit.append(None if letter else float("-inf"))
                continue
            share, fit = infer(text, probabilities)
            at = int(share.argmax())
            out_lang.append(names[at])
            out_score.append(float(min(1.0, share[at])))
            out_fit.append(fit if len(text.encode()) >= LEAST_TRIGRAMS else None)  # a trigram for each byte
        columns = [pa.array(out_lang, pa.string()), pa.array(out_score, pa.float64()), pa.array(out_fit, pa.float64())]
        return pa.StructArray.from_arrays(columns, ["lang", "score", "fit"])

    return run(text_of(text_col))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5


def keep_known(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents whose language cannot be told: no text, no letters in it, or unlike every learned language.

    A document in any learned language, or in several, stays. If no language was learned, letters alone decide.
    """
    model = learn(docs.where(fold(id_col) != 0), text_col, lang_col)
    told = predict(docs, model, text_col)
    return docs.select(F.struct("*").alias("row"), told["fit"].alias("fit")).where(F.coalesce(F.col("fit") >= LEAST_FIT, F.lit(True))).select("row.*")
