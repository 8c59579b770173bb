"""Token counts of whole texts by a two-tier lookup of pre-token lengths.

Splitting a text into pre-tokens is cheap; merging the bytes of each is not.
Lengths of the most frequent pre-tokens travel to every task as one small hash
table. Any other pre-token is encoded by the tokenizer's model when a worker first
meets it, and kept in that worker's cache. Neither
tier needs a shuffle of pre-tokens, and neither decides a result: a pre-token
missing from both is encoded.

Frequent pre-tokens come from all texts: each task keeps a Misra-Gries summary
of bounded size, and the summaries are added up in Spark.

Defined cases: a null text counts as the empty text with no tokens; repeated
rows give one row each; strings of added special tokens inside a text count as
one token, as the tokenizer does by default; text of any length is split in
one pass; further columns are kept by ``with_counts`` except one of the same
name as a result column, which is replaced.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.llm.common import stored, text_of
from wattlake.llm.exact_dedup import prune

#: Pre-tokens above ``1 / (TABLE_SIZE + 1)`` of all are in the broadcast table, at most twice as many: about 1.5 MB.
TABLE_SIZE = 8_192
#: Pre-tokens of a generation that a worker remembers beyond the table, about 40 MB. Those before
#: the last full generation are forgotten.
CACHED = 300_000
#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, the other bytes take the
    letters from U+0100 on in their order.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class Lengths(dict):
    """Pre-token -> number of tokens: a fixed table below, a bounded cache above.

    A pre-token that is in neither is merged by the tokenizer's own model.
    """

    def __init__(self, path: str, table: dict[str, int]):
        from tokenizers import Tokenizer

        super().__init__(table)
        with open(path, encoding="utf-8") as file:
            added = [t["content"] for t in json.load(file)["added_tokens"]]
        self.table, self.before = table, {}
        self.merge = Tokenizer.from_file(path).model.tokenize
        self.letters = byte_letters()
        self.ascii_letters = str.maketrans({b: self.letters[b] for b in range(128)})
        # The longest special string first, as the tokenizer matches them.
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.split = regex.compile(PRE_TOKEN).findall

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of the ordinary parts of a text, and how many special strings part them."""
        parts = self.special.split(text)
        return [t for part in parts for t in self.split(part)] if len(parts) > 1 else self.split(text), len(parts) - 1

    def __missing__(self, token: str) -> int:
        if len(self) > len(self.table) + CACHED:
            self.before = dict(self)
            self.clear()
            self.update(self.table)
        n = self.before.get(token)
        if n is None:
            spelled = token.translate(self.ascii_letters) if token.isascii() else "".join([self.letters[b] for b in token.encode()])
            n = len(self.merge(spelled))
        self[token] = n
        return n

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            tokens, specials = self.pre_tokens(text)
            out.append(sum(map(self.__getitem__, tokens)) + specials)
        return out


@lru_cache(maxsize=2)
def _worker(path: str, table: tuple[tuple[str, int], ...]) -> Lengths:
    """One cache per Python worker, kept from task to task."""
    return Lengths(path, dict(table))


def frequent_pre_tokens(docs: DataFrame, text_col: str, table_size: int = TABLE_SIZE) -> list[str]:
    """Every pre-token above ``1 / (table_size + 1)`` of all words, and at most ``2 * table_size + 1`` in all.

    Words between single spaces are counted, which is what nearly all frequent
    pre-tokens are; each is a pre-token together with the space before it. A
    summary has ``2 * table_size + 1`` counters, so its sums miss less than half of the wanted share.
    """
    counters = 2 * table_size + 1

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = text.split(" ")
                total += len(words)
                counts.update(words)
                if len(counts) > 8 * counters:
                    counts = Counter(prune(counts, counters))
        counts = prune(counts, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*counts, None], pa.string()), pa.array([*counts.values(), total], pa.int64())], ["word", "n"]
        )

    merged = stored(
        docs.select(text_of(text_col).alias("text"))
        .mapInArrow(summaries, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )
    total = merged.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    rows = merged.where(F.col("word").isNotNull() & (F.col("n") * (counters + 1) > total)).collect()
    return sorted(" " + r["word"] for r in rows)


def length_table(path: str, pre_tokens: list[str]) -> tuple[tuple[str, int], ...]:
    """``(pre-token, number of tokens)`` of those strings that are one pre-token each."""
    lengths = Lengths(path, {})
    single = [t for t in pre_tokens if lengths.pre_tokens(t) == ([t], 0)]
    return tuple(zip(single, lengths.count(single), strict=True))


def with_counts(docs: DataFrame, path: str, text_col: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens`` of the tokenizer file ``path``."""
    table = docs.sparkSession.sparkContext.broadcast(
        length_table(path, frequent_pre_tokens(docs, text_col, table_size))
    )

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        return pa.array(_worker(path, table.value).count(texts.to_pylist()), pa.int64())

    text = text_of(text_col)
    return docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": n_tokens(text)})
