"""Phrase collocation mining over a prefix-free parse.

Each piece of text is cut into overlapping chunks where its own words say so: a window
of ``max_words - 1`` words whose hash is divisible by ``CHUNK_WORDS`` ends a chunk and begins the next one, which
repeats that window. Equal passages are so cut alike wherever they stand, and the distinct chunks with
their number of occurrences (the dictionary and the parse frequencies) stand for the whole corpus. Phrases
are counted inside distinct chunks, weighted by the frequency. The words of an overlap belong to the later chunk: a phrase is
counted in the chunk that owns its first word, and the overlap is long enough to hold it whole, so every occurrence counts once.

Words are counted first, then pairs, then longer phrases. A phrase that reaches the least frequency is made of
shorter phrases that reach it too; those are looked up in a bit filter of bounded size (``FILTER_BITS``), which
may let others pass but stops none, so it spares work and decides no result. Counts are summed in the task before they are shuffled,
so a word or a chunk that makes up a third of the corpus is one row per task.

Defined cases: a null text is empty; a null language is ``und``, as is the language of that name; empty texts and texts
of separators alone count nothing; very long texts are cut like others; repeated rows count as often as they stand there; an empty table gives
an empty result; further columns are ignored; equal scores and counts are ranked by phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattlake.llm.common import stored, text_of

#: Mean number of words between two triggers.
CHUNK_WORDS = 16
#: Bits of the filter of frequent phrases: 16 for each, at most 16 MB.
FILTER_BITS = 1 << 27
#: Bytes of text that a task takes at once.
SLICE_BYTES = 4_000_000

#: A byte that no UTF-8 text has marks the places where pieces end.
_CUT = b"\xff"
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else 255 if chr(c) in ".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256)
)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: bytes) -> bytes:
    """The words of a text in lower case (A-Z only) with single spaces, and a cut mark wherever a piece ends."""
    return b" ".join(text.translate(_BYTES).replace(_CUT, b" \xff ").split())


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b + _ODD + (a << np.uint64(6)) + (a >> np.uint64(2)))) * _ODD
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of texts with single spaces, one text after another: number and 64-bit hash of each word."""

    def __init__(self, texts: pa.Array) -> None:
        split = pc.split_pattern(texts, b" ")
        words = split.flatten()
        coded = words.dictionary_encode()
        self.names = coded.dictionary
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.names.to_pylist()], np.uint64)[self.ids]
        self.sizes = pc.binary_length(words).to_numpy().astype(np.int64)
        self.per_text = pc.list_value_length(split).to_numpy().astype(np.int64)

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The ``n`` words from each place on."""
        parts = [self.names.take(pa.array(self.ids[at + k])) for k in range(n)]
        return pc.binary_join_element_wise(*parts, b" ").cast(pa.string())


def chunk_bounds(run: Words, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each chunk of a run of words and the number of words it owns."""
    cut = pc.index(run.names, pa.scalar(_CUT, pa.binary())).as_py()
    word = run.ids != cut
    whole, window = word.copy(), run.hashes.copy()
    for k in range(1, overlap):
        whole[-k:] = False
        whole[:-k] &= word[k:]
        window[:-k] = _mixed(window[:-k], run.hashes[k:])
    after_cut = np.concatenate([[True], ~word[:-1]]) if len(word) else word
    starts = np.flatnonzero(word & (after_cut | (whole & (window % np.uint64(CHUNK_WORDS) == 0))))
    cuts = np.append(np.flatnonzero(~word), len(word))
    ends = cuts[np.searchsorted(cuts, starts)]
    following = np.append(starts[1:], len(word))
    inner = following < ends
    return starts, np.where(inner, following + overlap, ends), np.where(inner, following, ends) - starts


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number from 0 for each different value, and the first place of each number."""
    numbers, different = pd.factorize(values)
    first = np.empty(len(different), np.int64)
    first[numbers[::-1]] = np.arange(len(values) - 1, -1, -1)
    return numbers, first


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes]]]:
    """Languages and texts, about ``SLICE_BYTES`` bytes at once."""
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.append((lang, text.as_py()))
            size += len(held[-1][1]) + 8
            if size >= SLICE_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of the dictionary, about ``SLICE_BYTES`` bytes at once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def parse(docs: DataFrame, max_words: int, lang_col: str, text_col: str) -> DataFrame:
    """``(lang, chunk, owned, freq)``: the dictionary of distinct chunks and how often the corpus is parsed into each."""
    overlap = max(1, max_words - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _texts(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in texts:
                by_lang.setdefault(lang, []).extend((pieces(text), _CUT))
            for lang, parts in by_lang.items():
                joined = b" ".join(filter(None, parts))
                words = Words(pa.array([joined], pa.binary()))
                starts, ends, owned = chunk_bounds(words, overlap)
                begin = np.cumsum(words.sizes + 1) - words.sizes - 1
                slices = zip(begin[starts].tolist(), (begin[ends - 1] + words.sizes[ends - 1]).tolist(), strict=True)
                coded = pa.array([joined[i:j] for i, j in slices], pa.binary()).dictionary_encode()
                # Chunks differ by their words and by whether they own the last ones.
                number, first = _numbered(coded.indices.to_numpy() * 2 + (ends - starts == owned))
                columns = [
                    pa.array([lang] * len(first), pa.string()),
                    coded.dictionary.take(coded.indices.take(pa.array(first))).cast(pa.string()),
                    pa.array(owned[first].astype(np.int32)),
                    pa.array(np.bincount(number, minlength=len(first)).astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "owned", "freq"])

    rows = docs.select(
        F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), text_of(text_col).cast("binary").alias("text")
    )
    chunks = rows.mapInArrow(run, "lang string, chunk string, owned int, freq long")
    return chunks.groupBy("lang", "chunk", "owned").agg(F.sum("freq").alias("freq"))


def _phrase_hashes(first: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the phrase of ``n`` words that begins at each place; ``first`` is that of the language."""
    found = _mixed(first, hashes)
    for k in range(1, n):
        found[:-k] = _mixed(found[:-k], hashes[k:])
    return found


class BitFilter:
    """Set of phrases in bits: finds all that were put in, and few others."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def slots(hashes: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The two bits of each hash; ``n_bits`` is a power of two."""
        last = np.uint64(n_bits - 1)
        return (hashes & last).astype(np.int64), ((hashes >> np.uint64(32)) * _ODD >> np.uint64(20) & last).astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for slot in self.slots(hashes, len(self.bits) * 64):
            found &= (self.bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return found

    @classmethod
    def of(cls, phrases: DataFrame, n: int) -> BitFilter:
        """Filter of the phrases ``(lang, phrase)`` of ``n`` words."""
        n_bits = 1 << 16
        while n_bits < min(FILTER_BITS, 16 * phrases.count()):
            n_bits *= 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs = [xxhash.xxh64_intdigest(lang.as_py()) for lang in batch.column(0)]
                words = Words(batch.column(1))
                hashes = _phrase_hashes(np.repeat(np.array(langs, np.uint64), n), words.hashes, n)[::n]
                slots = np.concatenate(cls.slots(hashes, n_bits))
                bits = np.uint64(1) << (slots & 63).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(bits.view(np.int64))], ["place", "bits"])

        rows = phrases.select("lang", F.col("phrase").cast("binary").alias("phrase"))
        found = rows.mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
        bits = np.zeros(n_bits // 64, np.uint64)
        bits[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
        return cls(bits)


def phrase_counts(dictionary: DataFrame, lengths: range, least: int, shorter: BitFilter | None = None) -> DataFrame:
    """``(lang, phrase, f, words)`` of the phrases of ``lengths`` words with ``least`` occurrences or more.

    ``shorter`` holds the phrases of one word less than the shortest that reach ``least``.
    """
    known = lengths[0] - 1
    # Bounded by FILTER_BITS.
    shared = dictionary.sparkSession.sparkContext.broadcast(shorter.bits) if shorter is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = BitFilter(shared.value) if shared is not None else None
        for rows in _tables(batches):
            words = Words(rows["chunk"].combine_chunks())
            owned, freq = rows["owned"].to_numpy(), rows["freq"].to_numpy()
            coded = rows["lang"].combine_chunks().dictionary_encode()
            names, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            # The row of each place, and the words of its chunk from there on.
            row = np.repeat(np.arange(len(owned)), words.per_text)
            ends = np.cumsum(words.per_text)
            left = ends[row] - np.arange(len(row))
            own = left > (words.per_text - owned)[row]
            if found is not None:
                first = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)[lang[row]]
                part = found.holds(_phrase_hashes(first, words.hashes, known))
            at = np.flatnonzero(own & (left >= lengths[0]))
            for n in lengths:
                at = at[left[at] >= n]
                if found is not None:  # every phrase of the known length inside, the earlier ones by the shorter phrases
                    at = at[part[at + n - known]] if n > lengths[0] else at[part[at] & part[at + 1]]
                number = lang[row[at]] * len(words.names) + words.ids[at]
                for k in range(1, n):
                    if k > 1:
                        number = _numbered(number)[0]
                    number = number * len(words.names) + words.ids[at + k]
                number, place = _numbered(number)
                total = np.bincount(number, freq[row[at]], len(place)).astype(np.int64)  # exact below 2^53
                place = at[place]
                columns = [
                    coded.dictionary.take(pa.array(lang[row[place]])),
                    words.phrases(place, n),
                    pa.array(total),
                    pa.array(np.full(len(place), n, np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f", "words"])

    rows = dictionary.select("lang", F.col("chunk").cast("binary").alias("chunk"), "owned", "freq")
    found = rows.mapInArrow(run, "lang string, phrase string, f long, words int")
    found = found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return stored(found.where(F.col("f") >= least))


def frequent_phrases(dictionary: DataFrame, least: int, max_words: int) -> DataFrame:
    """``(lang, phrase, f, words)``: the phrases of 1 to ``max_words`` words with ``least`` occurrences or more.

    Words, then pairs of frequent words, then all longer phrases whose pairs are frequent.
    """
    found = [phrase_counts(dictionary, range(1, 2), least)]
    for lengths in (range(2, 3), range(3, max_words + 1)):
        if lengths:
            found.append(phrase_counts(dictionary, lengths, least, BitFilter.of(found[-1], lengths[0] - 1)))
    return reduce(DataFrame.unionByName, found)


def scored(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` by the lowest-scoring cut of each candidate ``(lang, phrase, f)``."""
    parts_ = F.split("phrase", " ").alias("parts")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", parts_).select("*", cut)
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("parts", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"),
    )
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    # As a decimal, since the product may pass 64 bits.
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + r)")
    told = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return told.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def swallowed(candidates: DataFrame, max_words: int) -> DataFrame:
    """``(lang, phrase, longer)``: phrases inside longer candidates and the most occurrences of such a one."""
    inner = []
    for n in range(3, max_words + 1):
        words = candidates.where(F.col("words") == n).select("lang", "f", F.split("phrase", " ").alias("parts"))
        parts = F.array(*[
            F.array_join(F.slice("parts", at, m), " ") for m in range(2, n) for at in range(1, n - m + 2)
        ])
        inner.append(words.select("lang", F.explode(parts).alias("phrase"), "f"))
    if not inner:
        return candidates.select("lang", "phrase", F.col("f").alias("longer")).limit(0)
    return reduce(DataFrame.unionByName, inner).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(
    docs: DataFrame, least: int = 30, max_words: int = 4, first: int = 2000, covered: int = 80,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``first`` best phrases of 2 to ``max_words`` words of each language.

    A phrase goes if a longer candidate that holds it has at least ``covered`` hundredths of its occurrences.
    """
    if max_words < 2:
        raise ValueError("a collocation has two words or more")
    dictionary = stored(parse(docs, max_words, lang_col, text_col))
    totals = stored(dictionary.groupBy("lang").agg(F.sum(F.col("freq") * F.col("owned")).alias("n")))
    phrases = frequent_phrases(dictionary, least, max_words)
    candidates = phrases.where("words > 1")
    longer = swallowed(candidates, max_words)
    told = stored(scored(candidates, phrases.where(F.col("words") < max_words)))
    kept = told.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", place).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
