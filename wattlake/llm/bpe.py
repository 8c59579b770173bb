"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word is a row of two arrays: its parts from left to right, and the merge
rank of each adjacent pair. The smallest rank is found by a scan, the boundary
at that place is deleted by moving the rest of both arrays one step left, and
the ranks on both sides of the new part are looked up again, until no pair has
a rank. Words are short, so a scan beats any heap; many new words are held as
rows of one matrix, so one numpy call makes a step of all of them. Words over
``SHORT`` bytes would make that quadratic and take a heap instead.

Each worker keeps the ids of words it has met. Ids are turned back into text
from the ids alone: the bytes of all of a document's parts, read as UTF-8.

Defined cases: a null text counts as the empty text and has no ids; repeated
rows give one row each; the strings of added special tokens become their own
id, as by the tokenizer's default, and are text again when decoded; bytes that
are no UTF-8 decode to the replacement character; texts of any length are
encoded whole; other columns are neither read nor changed.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.llm.common import text_of
from wattlake.llm.token_counts import PRE_TOKEN, byte_letters

#: Longest word, in bytes, of the rank matrix.
SHORT = 48
#: Words a worker remembers, about 60 MB; a full cache starts anew.
CACHE_SIZE = 400_000
#: Bytes of text turned into one result batch.
BATCH_BYTES = 4_000_000
NO_RANK = np.iinfo(np.int32).max


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: content.encode() for content, i in self.special_ids.items()}
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int32)
        self.base = max(vocab.values()) + 2
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        self.rank_order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.rank_order]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.special = regex.compile(
            "|".join(map(regex.escape, sorted(self.special_ids, key=len, reverse=True))) or r"(?!)"
        )
        self.split = regex.compile(PRE_TOKEN).findall
        self.cache: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of parts; a part below 0 is none."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.rank_order[at], NO_RANK)

    def encode_short(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of each word, packed as 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        width = max(map(len, words))
        parts = np.full((len(words), width + 1), -1, np.int32)  # the last column stays empty
        for i, word in enumerate(words):
            parts[i, : len(word)] = self.byte_ids[np.frombuffer(word, np.uint8)]
        rank = np.full((len(words), width + 1), NO_RANK, np.int32)
        rank[:, :-1] = self.ranks(parts[:, :-1], parts[:, 1:])
        who = np.arange(len(words))
        columns = np.arange(width + 1)
        while len(who):
            place = rank.argmin(1)
            least = rank[np.arange(len(who)), place]
            live = least < NO_RANK
            if not live.all():
                for i, row in zip(who[~live], parts[~live], strict=True):
                    out[i] = row[row >= 0].tobytes()
                parts, rank, who, place, least = parts[live], rank[live], who[live], place[live], least[live]
                if not len(who):
                    break
            rows = np.arange(len(who))
            source = np.minimum(columns + (columns > place[:, None]), width)
            parts = np.take_along_axis(parts, source, 1)
            rank = np.take_along_axis(rank, source, 1)
            parts[rows, place] = self.merged[least]
            rank[rows, place] = self.ranks(parts[rows, place], parts[rows, place + 1])
            inner = place > 0
            rank[rows[inner], place[inner] - 1] = self.ranks(
                parts[rows[inner], place[inner] - 1], parts[rows[inner], place[inner]]
            )
        return out

    def encode_long(self, word: bytes) -> bytes:
        """The same merges for a word too long to scan: a heap of ranks over linked parts."""
        part = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.ranks(np.array(part[:-1]), np.array(part[1:]))
        heap = [(int(r), i, part[i], part[i + 1]) for i, r in enumerate(first) if r < NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue  # one of the two has been merged since
            part[i], part[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    rank = int(self.ranks(np.array([part[left]]), np.array([part[right]]))[0])
                    if rank < NO_RANK:
                        heapq.heappush(heap, (rank, left, part[left], part[right]))
        return np.array([p for p in part if p >= 0], np.int32).tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words not met yet, in matrices of words of similar length."""
        if len(self.cache) > CACHE_SIZE:
            self.cache.clear()
        new = sorted({w for w in words if w not in self.cache}, key=lambda w: len(w))
        coded = [w.encode() for w in new]
        short = [i for i, w in enumerate(coded) if len(w) <= SHORT]
        for at in range(0, len(short), 4096):
            some = short[at : at + 4096]
            for i, ids in zip(some, self.encode_short([coded[i] for i in some]), strict=True):
                self.cache[new[i]] = ids
        for word, data in zip(new, coded, strict=True):
            if len(data) > SHORT:
                self.cache[word] = self.encode_long(data)

    def words(self, text: str) -> tuple[list[str], ...]:
        """Pre-tokens of the text's ordinary parts, with each special string as a list of its own between them."""
        parts = self.special.split(text)
        if len(parts) == 1:
            return (self.split(text),)
        between = self.special.findall(text)
        out = [self.split(parts[0])]
        for special, part in zip(between, parts[1:], strict=True):
            out += [[special], self.split(part)]
        return tuple(out)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self.words(t) for t in texts]
        self.learn(w for lists in split for words in lists[::2] for w in words)
        get = self.cache.__getitem__
        out = []
        for lists in split:
            if len(lists) == 1:
                packed = b"".join(map(get, lists[0]))
            else:
                packed = b"".join(
                    np.int32(self.special_ids[words[0]]).tobytes() if i % 2 else b"".join(map(get, words))
                    for i, words in enumerate(lists)
                )
            out.append(np.frombuffer(packed, np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec and cache per Python worker, kept from task to task."""
    return Codec(path)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``BATCH_BYTES`` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BATCH_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _ids_array(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, token_ids, decoded)`` of every row: the ids, and the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in _groups(texts):
                ids = code.encode(texts[start:end])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        _ids_array(ids),
                        pa.array([code.decode(x) for x in ids], pa.string()),
                    ],
                    ["doc_id", "token_ids", "decoded"],
                )

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, token_ids array<int>, decoded string")
