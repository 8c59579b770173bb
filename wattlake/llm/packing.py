"""Best-fit packing of token sequences through a configuration linear program.

Documents are tokenised once, cut at the sequence length and written as pieces.
What the packing needs is the histogram of piece lengths: at most ``capacity``
numbers, whatever the corpus. On it the configuration program is solved - a
configuration is a multiset of lengths that fits one sequence, and each length
must be covered as often as it occurs. Multiplicative weights hold a price per
length; each round a knapsack dynamic program over the lengths that are left finds the highest
price of a sequence, and configurations that reach it are taken one after another, each as
often as the remaining demand allows; prices of covered lengths fall with the covered share
of their demand. The prices also give a lower bound on the number of sequences. Since
configurations are taken in whole sequences, rounding decides how many of them stay, in
their order: later ones find fewer lengths to fill a sequence with. What is left over is
placed best-fit, longest first, on the histogram as well. The plan with the fewest sequences
counts, of equal ones that with most configurations.

The plan is a list of runs, "the pieces of this length with these ranks lie at
this place of these sequences". A piece finds its run by its rank among the
pieces of its length. Ranks come from counts per (length, cell), with about
``sqrt(pieces)`` cells, so a length that a third of all pieces have is ranked by
many tasks.

Defined cases: a null text counts as the empty text, which is the end id alone;
repeated rows are packed once each; texts of any length are cut into pieces, of
which only the last may be shorter than the capacity; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattlake.llm.common import stored, text_of
from wattlake.llm.token_counts import byte_letters

#: Words, and parts of words, of one generation that a worker remembers; those before the last
#: full generation are forgotten. Up to 150 MB together.
CACHED_WORDS = 150_000
CACHED_PARTS = 250_000
#: Fixed value: the part pattern of the word-level vocabulary, which drops what it does not match.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Rounds of the multiplicative weights, each with one knapsack program, and configurations taken in a round at most.
ROUNDS = 120
COLUMNS = 64
#: How far a price falls (as a power of e) when all of a length's demand is covered.
STEP = 0.1
#: A configuration may lie below the highest price by this share, by four times as much after a
#: round that found none, up to ``WORST``.
SLACK = 1e-4
WORST = 2e-3
#: The program ends when it covers this share of all tokens.
COVERED = 0.97
#: Shares of the program's tokens at which it is rounded; 0 is best-fit alone.
SHARES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.25, 0.0)
#: Tokens in one result batch.
BATCH_TOKENS = 1_000_000


class WordIds(dict):
    """Word between spaces -> its ids, packed as little-endian 32-bit integers.

    The tokenizer drops white space and never joins characters across it, and
    none of its normalisations reaches across a space, so a text's ids are those
    of its words in order. A new word of letters, digits, punctuation and
    symbols is normalised and split here by the tokenizer's rules and only its
    new parts are merged by the tokenizer's model; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS, cached_parts: int = CACHED_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.cached_words, self.cached_parts = cached_words, cached_parts
        self.before: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, added)) or r"(?!)")
        # A special string with a space in it would be cut by the split into words.
        self.whole = any(" " in a or "\n" in a for a in added)
        self.split = regex.compile(PRE_TOKEN).findall
        self.plain = regex.compile(r"[\p{L}\p{N}\p{P}\p{S}]+").fullmatch
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.packed = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]
        self.parts: dict[str, bytes] = {}
        self.parts_before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.cached_words:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word) if word else b""
        if ids is not None:
            pass
        elif word.isalpha() and (low := lowered(word)).isalpha():  # nothing to split
            ids = self.part(low)
        elif word[-1] in ".,;:!?" and (low := lowered(word[:-1])).isalpha():  # the end of a clause
            ids = self.part(low) + self.part(word[-1])
        elif self.plain(word) and not self.special.search(word):
            ids = b"".join(map(self.part, self.split(lowered(word))))
        else:
            ids = self.encode_whole(word)
        self[word] = ids
        return ids

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part) or self.parts_before.get(part)
        if ids is None:
            spelled = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            ids = b"".join([self.packed[t.id] for t in self.merge(spelled)])
        if len(self.parts) > self.cached_parts:
            self.parts_before, self.parts = self.parts, {}
        self.parts[part] = ids
        return ids

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.whole:
            return self.encode_whole(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def lowered(word: str) -> str:
    """Composed (NFC) and lower-cased letter by letter, so without the rule for a final sigma."""
    return word.lower() if word.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", word)])


@lru_cache(maxsize=2)
def word_ids(path: str, cached_words: int, cached_parts: int) -> WordIds:
    """One cache per Python worker, kept from task to task."""
    return WordIds(path, cached_words, cached_parts)


def pieces(
    docs: DataFrame, path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    cached_words: int = CACHED_WORDS, cached_parts: int = CACHED_PARTS,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: every text's ids and the end id, cut at ``capacity``.

    ``ids`` are little-endian 32-bit integers. Smaller caches trade CPU time for workers' memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = word_ids(path, cached_words, cached_parts), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys = batch.column(0)
            row, piece, start, length, ids, size = [], [], [], [], [], 0
            for i, text in enumerate(batch.column(1)):
                packed = coder.encode(text.as_py()) + end
                total = len(packed) // 4
                for k, at in enumerate(range(0, total, capacity)):
                    n = min(capacity, total - at)
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    ids.append(packed[4 * at : 4 * (at + n)])
                    size += n
                if size >= BATCH_TOKENS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                         pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                        ["doc_id", "piece", "start", "length", "ids"],
                    )
                    row, piece, start, length, ids, size = [], [], [], [], [], 0

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def best_values(lengths: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming: the highest total price of a multiset of lengths for each room up to ``capacity``."""
    value = np.zeros(capacity + 1)
    usable = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        k = usable[room]
        value[room] = max(value[room - 1], (value[room - lengths[:k]] + price[:k]).max()) if k else value[room - 1]
    return value


def configuration(
    lengths: np.ndarray, price: np.ndarray, value: np.ndarray, left: np.ndarray, slack: float = 0.0, worst: float = 1e-9
) -> dict[int, int]:
    """A multiset of the lengths that are left whose price reaches the highest one but for ``worst``; empty if none was found.

    Walks the knapsack's values from the full room down and takes the longest piece that costs no more than ``slack``
    in all, else the step that costs least. Returns index -> copies.
    """
    room, lost, found = len(value) - 1, 0.0, {}
    free = left.copy()
    while room >= lengths[0]:
        k = int(np.searchsorted(lengths, room, "right"))
        loss = np.where(free[:k] > 0, value[room] - price[:k] - value[room - lengths[:k]], np.inf)
        cheap = np.flatnonzero(loss <= max(slack - lost, 0.0) + 1e-12)
        at = int(cheap[-1]) if len(cheap) else int(loss.argmin())
        waste = value[room] - value[room - 1]
        if len(cheap) or loss[at] <= waste:
            lost += max(float(loss[at]), 0.0)
            found[at] = found.get(at, 0) + 1
            free[at] -= 1
            room -= int(lengths[at])
        else:
            lost += waste
            room -= 1
        if lost > worst:
            return {}
    return found


def best_configuration(lengths: np.ndarray, price: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths of the highest total price that fits. ``lengths`` ascend. Returns index -> copies."""
    return configuration(lengths, price, best_values(lengths, price, capacity), capacity // lengths)


def fractional(
    lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS
) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Configurations (length -> copies) in the order taken with their numbers of sequences, and a lower bound on all sequences.

    The bound is the demand at the prices, over the highest price of a sequence; it holds for every packing.
    """
    left, weight = demand.astype(np.int64), np.ones(len(lengths))
    total = int(lengths.dot(left))
    taken, bound, slack = [], 0.0, SLACK
    for _ in range(rounds):
        alive = np.flatnonzero(left)
        if lengths.dot(left) <= (1 - COVERED) * total:
            break
        some, price = lengths[alive], (weight * lengths / capacity)[alive]
        value = best_values(some, price, capacity)
        if len(alive) == len(lengths):
            bound = max(bound, float(price.dot(demand) / value[-1]))
        for n_found in range(COLUMNS):  # noqa: B007
            config = configuration(some, price, value, left[alive], slack * value[-1], WORST * value[-1])
            if not config:
                break
            at, copies = alive[list(config)], np.array(list(config.values()))
            times = int((left[at] // copies).min())
            left[at] -= times * copies
            weight[at] *= np.exp(-STEP * times * copies / demand[at])
            taken.append(({int(lengths[i]): int(c) for i, c in zip(at, copies, strict=True)}, times))
        if not config and not n_found:
            if slack >= WORST:
                break
            slack = min(4 * slack, WORST)
    return taken, bound


def first_part(program: list[tuple[dict[int, int], int]], share: float) -> list[tuple[dict[int, int], int]]:
    """The first configurations of a program, which hold ``share`` of its tokens; the last one in part."""
    sizes = [sum(k * c for k, c in config.items()) for config, _ in program]
    rest, part = share * sum(size * n for size, (_, n) in zip(sizes, program, strict=True)), []
    for size, (config, n) in zip(sizes, program, strict=True):
        whole = min(n, int(rest // size))
        if whole < 1:
            break
        part.append((config, whole))
        rest -= size * whole
    return part


def rounded(
    histogram: dict[int, int], program: list[tuple[dict[int, int], int]], capacity: int
) -> list[tuple[dict[int, int], int]]:
    """The sequences of a program, and best-fit for the lengths that are left over.

    ``program`` holds configurations by length. Left-over lengths go, longest first, to the
    sequences with the least free room that holds them.
    """
    left = dict(histogram)
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    for config, amount in program:
        whole = min(amount, *(left[length] // copies for length, copies in config.items()))
        if whole > 0:
            open_.setdefault(capacity - sum(k * c for k, c in config.items()), []).append((config, whole))
            for length, copies in config.items():
                left[length] -= copies * whole
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            rooms = [r for r in open_ if r >= length]
            if rooms:
                room = min(rooms)
                config, n = open_[room].pop()
                copies = min(room // length, count)
                used = min(n, count // copies)
                if used < n:
                    open_[room].append((config, n - used))
                if not open_[room]:
                    del open_[room]
            else:
                room, config, copies = capacity, {}, min(capacity // length, count)
                used = count // copies
            wider = {**config, length: config.get(length, 0) + copies}
            open_.setdefault(room - copies * length, []).append((wider, used))
            count -= copies * used
    return [group for groups in open_.values() for group in groups]


def pack_histogram(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """``(length -> copies, number of sequences)`` that holds every piece of the histogram exactly once.

    Never more sequences than best-fit alone, which is one of the plans compared.
    """
    full = histogram.get(capacity, 0)
    rest = {k: n for k, n in histogram.items() if k < capacity and n}
    plan: list[tuple[dict[int, int], int]] = [({capacity: 1}, full)] if full else []
    if not rest:
        return plan
    lengths = np.array(sorted(rest), np.int64)
    program, _ = fractional(lengths, np.array([rest[int(k)] for k in lengths]), capacity, rounds)
    plans = [rounded(rest, first_part(program, share), capacity) for share in SHARES]
    return plan + min(plans, key=lambda groups: sum(n for _, n in groups))


def runs(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan by length: from rank ``rank`` on, pieces lie in sequences from ``sequence`` on, at ``offset``."""
    rows, next_rank, sequence = [], {}, 0
    for config, n in plan:
        offset = 0
        for length, copies in sorted(config.items(), reverse=True):
            for _ in range(copies):
                rows.append((length, next_rank.get(length, 0), sequence, offset))
                next_rank[length] = next_rank.get(length, 0) + n
                offset += length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


#: Ranks stay below this, so (length, rank) is one number.
RANKS = 1 << 48


def _ranked(cut: DataFrame) -> DataFrame:
    """Rank of each piece among those of its length, from 0 without gaps."""
    n = cut.count()
    cells = max(1, math.isqrt(n))
    rows = cut.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("length", "cell").agg(F.count("*").alias("n")).select(
        "length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("length", "cell").orderBy("doc_id", "piece")
    return (
        rows.withColumn("inside", F.row_number().over(inside) - 1)
        .join(counts, ["length", "cell"])
        .withColumn("rank", F.col("before") + F.col("inside"))
        .drop("cell", "inside", "before")
    )


def pack(cut: DataFrame, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """``cut`` pieces with ``sequence_id`` and ``offset``; needs the columns ``doc_id``, ``piece`` and ``length``.

    The driver holds the histogram and the plan: up to ``capacity`` lengths and a
    few thousand runs, however many pieces there are.
    """
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = runs(pack_histogram(histogram, capacity, rounds))
    table["key"] = table["length"] * RANKS + table["rank"]
    sent = cut.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = sent.value
        at = np.searchsorted(t["key"], length.to_numpy() * RANKS + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": t["sequence"][at] + rank.to_numpy() - t["rank"][at], "offset": t["offset"][at]})

    placed = _ranked(cut).withColumn("to", place("length", "rank"))
    return placed.select(*cut.columns, "to.sequence_id", "to.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, spans)``: the ids of each sequence in order; a sequence is at most ``capacity`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("spans"),
    )


def pack_documents(
    docs: DataFrame, path: str, capacity: int, end_id: int = 0, cached_words: int = CACHED_WORDS, cached_parts: int = CACHED_PARTS
) -> DataFrame:
    """Pieces of all documents with the checksum of their ids and their place; the ids are written once, as a table."""
    cut = stored(pieces(docs, path, capacity, end_id, cached_words=cached_words, cached_parts=cached_parts))
    narrow = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(narrow, capacity)
