"""SimHash near-duplicates through pivot distance tables.

Each distinct fingerprint gets its Hamming distances to many reference
fingerprints (pivots). By the triangle inequality two fingerprints within
``radius`` bits differ by at most ``radius`` in every coordinate, so a pair with
a larger coordinate difference is discarded without looking at its bits.

The table also blocks the search. Most pivots have their bits inside one of
``GROUPS`` bands of the fingerprint; such a distance less the distance to the zero
pivot depends on that band alone. A difference of ``radius`` bits touches at most
``radius`` bands, so the coordinates of some ``GROUPS - radius`` bands are equal:
these are the join keys, one per choice of bands. Pairs that share a key are
then compared by the coordinates of the full-width pivots and, if they survive,
by their bits.

A key with over ``BLOCK`` fingerprints is not paired up. Its fingerprints go
through an exact way that is linear in their number: fingerprints within two
bits of each other share a word within one bit of both, so each is sent to the
65 words around it and linked to the least fingerprint there. Links are few
compared to copies, because equal texts and equal fingerprints are one row from
the start, and classes come from connected components over tables.

Defined cases: a null text counts as the empty text; a text without words has
fingerprint zero and links like any other; a text shorter than a shingle is one
shingle; repeated rows give one row each; a null id never becomes a class id
unless a class has no other; further columns are ignored by ``near_duplicates`` and
kept by ``keep_one``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.llm.common import stored, text_of
from wattlake.llm.components import components

#: Bands of the 64 bits and pivots inside each.
GROUPS = 5
PIVOTS_PER_GROUP = 8
#: Pivots over all bits, compared pair by pair.
WIDE_PIVOTS = 8
#: Fingerprints of one key that are compared pair by pair.
BLOCK = 16
HASH_SEED = 42
#: Near-duplicate stage: words of a shingle, min-hashes of a set, and the most probability that the
#: search misses a pair at the wanted similarity.
SET_WORDS = 5
MIN_HASHES = 160
MISSED = 1e-5
#: Members of a star that are worth further leaders, the share of them that a leader has to link, and leaders at most.
LARGE_STAR = 64
WORTHWHILE = 0.05
LEADERS = 16
#: A difference counts as common in a star from this share of its members on.
COMMON = 64
FACTORS, OFFSETS = np.random.default_rng(11).integers(0, 1 << 63, (2, MIN_HASHES, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes, words_per_shingle: int) -> int:
    """64-bit SimHash over word shingles with repeats, as a signed integer."""
    words = text.lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(words_per_shingle)], strict=False))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, HASH_SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    votes = np.unpackbits(hashes, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int) -> DataFrame:
    """``(doc_id, text_hash, fp)`` of every row; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"]
            )

    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.xxhash64(text_of(text_col)).alias("text_hash"),
        text_of(text_col).cast("binary").alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def pivots(width: int, seed: int = 7) -> tuple[list[list[int]], list[int]]:
    """Reference fingerprints of the low ``width`` bits: those of each band, and those over all bits, as signed integers."""
    rng = np.random.default_rng(seed)
    signed = lambda bits: int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)
    bands = np.array_split(np.arange(64 - width, 64), GROUPS)
    banded = []
    for band in bands:
        own = []
        for _ in range(PIVOTS_PER_GROUP):
            bits = np.zeros(64, np.uint8)
            bits[rng.permutation(band)[: len(band) // 2]] = 1
            own.append(signed(bits))
        banded.append(own)
    used = (np.arange(64) >= 64 - width).astype(np.uint8)
    return banded, [signed(rng.integers(0, 2, 64).astype(np.uint8) * used) for _ in range(WIDE_PIVOTS)]


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(pivot)))


def pivot_table(fps: DataFrame, radius: int, width: int) -> DataFrame:
    """``(key, view, fp, wide)``: each fingerprint of each view once per choice of bands.

    ``wide`` holds the distances to the full-width pivots, a byte each.
    """
    banded, wide = pivots(width)
    fp = F.col("fp")
    zero = _distance(fp, 0)
    bands = [
        reduce(lambda a, b: a * 65 + b, [(_distance(fp, p) - zero + 32).cast("long") for p in own]) for own in banded
    ]
    table = fps.select(
        "view",
        "fp",
        reduce(lambda a, b: F.shiftleft(a, 8).bitwiseOR(b), [_distance(fp, p).cast("long") for p in wide]).alias("wide"),
        *[c.alias(f"band{i}") for i, c in enumerate(bands)],
    )
    keys = [
        F.xxhash64("view", F.lit(n), *[F.col(f"band{i}") for i in chosen])
        for n, chosen in enumerate(combinations(range(GROUPS), GROUPS - radius))
    ]
    return table.select(F.explode(F.array(*keys)).alias("key"), "view", "fp", "wide")


def _near(radius: int) -> Column:
    """No coordinate of the two pivot rows differs by more than ``radius``."""
    byte = lambda c, i: F.shiftrightunsigned(F.col(c), 8 * i).bitwiseAND(F.lit(255))
    return reduce(
        lambda a, b: a & b, [F.abs(byte("wide", i) - byte("wide2", i)) <= radius for i in range(WIDE_PIVOTS)]
    )


def links(fps: DataFrame, radius: int = 2, width: int = 64) -> DataFrame:
    """Links ``(view, u, v)`` between distinct fingerprints ``(view, fp)`` of ``width`` bits, each within its view.

    Every pair within ``radius`` bits is joined by a path of links, and no link is longer.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the exact way of large blocks holds for up to two bits")
    table = pivot_table(fps, radius, width)
    sizes = table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(table.join(sizes, "key"))
    small = shared.where(F.col("n") <= BLOCK).select("key", "view", "fp", "wide")
    other = small.select("key", F.col("view").alias("view2"), F.col("fp").alias("fp2"), F.col("wide").alias("wide2"))
    paired = (
        small.join(other, "key")
        .where((F.col("view") == F.col("view2")) & (F.col("fp") > F.col("fp2")) & _near(radius))
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
        .select("view", F.col("fp").alias("u"), F.col("fp2").alias("v"))
    )
    # Words around each fingerprint of the large blocks: itself, and with bits to spare each with one bit flipped.
    flips = [0] + [1 << b if b < 63 else -(1 << 63) for b in range(width if radius else 0)]
    around = (
        shared.where(F.col("n") > BLOCK)
        .select("view", "fp")
        .distinct()
        .select("view", "fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("word"))
    )
    stars = (
        around.groupBy("view", "word")
        .agg(F.min("fp").alias("v"), F.collect_set("fp").alias("us"))  # at most 65 fingerprints are so near one word
        .where(F.size("us") > 1)
        .select("view", F.explode("us").alias("u"), "v")
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    )
    return paired.unionByName(stars).where("u <> v").distinct()


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """``(fp, root, first)``: the class of each fingerprint and the first document of the fingerprint.

    ``first`` sorts by id with null ids last, then by text hash.
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = stored(rows.groupBy("fp").agg(F.min(first).alias("first")))
    found = links(nodes.select(F.lit(0).alias("view"), "fp"), radius)
    roots = stored(components(found.select("u", "v")))
    return nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, radius: int = 2
) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; the class id is the smallest id of the class."""
    rows = stored(fingerprints(docs, id_col, text_col, words_per_shingle))
    classes = stored(_classes(rows, radius))
    first = classes.groupBy("root").agg(F.min("first").alias("first"))
    named = stored(classes.select("fp", "root").join(first, "root").select("fp", F.col("first.doc_id").alias("component_id")))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a line repeated many times does not make texts alike."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= SET_WORDS:
        parts = [b" ".join(words)]
    else:
        parts = set(map(b" ".join, zip(*[words[i:] for i in range(SET_WORDS)], strict=False)))
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(p, HASH_SEED) for p in parts]), ">u8").astype(np.uint64))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """``MIN_HASHES`` least values; two sets agree in one with the probability of their Jaccard similarity."""
    least = np.full(MIN_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[at : at + 512] * FACTORS + OFFSETS).min(1))
    return least


def band_rows(similarity: float) -> int:
    """Most min-hashes of a band such that a pair at ``similarity`` misses every band with at most ``MISSED`` probability."""
    return max(
        (r for r in range(1, MIN_HASHES + 1) if (1 - similarity**r) ** (MIN_HASHES // r) <= MISSED), default=1
    )


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each band of ``rows`` min-hashes."""
    bands = least[: len(least) // rows * rows].reshape(-1, rows)
    keys = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for i in range(rows):
        keys = (keys ^ bands[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def band_table(docs: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """``(doc_id, text_hash, node, keys)`` of every row; one pass over the texts. ``node`` stands for the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = [], []
            for text in batch.column(2):
                found = shingles(text.as_py())
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), HASH_SEED))
                keys.append(band_keys(min_hashes(found), rows))
            flat = pa.array(np.concatenate([*keys, np.empty(0, np.int64)]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, MIN_HASHES // rows, np.int32)), flat)
            columns = [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "keys"])

    texts = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.xxhash64(text_of(text_col)).alias("text_hash"),
        text_of(text_col).cast("binary").alias("text"),
    )
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, text_hash long, node long, keys array<long>")


def _sides(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("p"))
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("q"))
    return pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "p", "q")


def differences(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(u, v, n, m, linked, apart)``: sizes of both sets, whether they are alike, and the hashes that only one of them holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, apart = [], [], [np.empty(0, np.uint64)]
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                n.append(len(x))
                m.append(len(y))
                apart.append(np.setxor1d(x, y, assume_unique=True))
            ends = np.cumsum([len(a) for a in apart])
            shared = (np.array(n) + np.array(m) - np.diff(ends)) // 2
            linked = shared / np.maximum(np.array(n) + np.array(m) - shared, 1) >= similarity
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(apart).view(np.int64)))
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(linked), lists]
            yield pa.RecordBatch.from_arrays(columns, ["u", "v", "n", "m", "linked", "apart"])

    return stored(_sides(pairs, sets).mapInArrow(run, "u long, v long, n long, m long, linked boolean, apart array<long>"))


def shingle_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """``(node, hashes)``: the shingle sets of the wanted nodes, hashes of eight bytes each in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "hashes"])

    of_text = nodes.join(wanted, "node", "left_semi").select("node", F.col("first.text_hash").alias("text_hash"))
    texts = docs.select(F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).cast("binary").alias("text"))
    # Rows with an equal text are one: the text of any of them will do.
    found = texts.join(of_text, "text_hash").select("node", "text").mapInArrow(run, "node long, hashes binary")
    return stored(found.groupBy("node").agg(F.first("hashes").alias("hashes")))


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(u, v)`` whose shingle sets have a Jaccard similarity of ``similarity`` or more."""

    def same(p: bytes, q: bytes) -> bool:
        x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared / (len(x) + len(y) - shared) >= similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = [same(p.as_py(), q.as_py()) for p, q in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(fit, pa.bool_()))

    return stored(_sides(pairs, sets).mapInArrow(run, "u long, v long"))


def stars(buckets: DataFrame) -> DataFrame:
    """``(u, v, weight)``: hubs and their members, from ``(node, bucket)``. Nodes that share a bucket are both in the star of one hub.

    A bucket is led by the member whose buckets are largest together (``weight``), which in a group of edited copies lies near what they
    have in common; buckets whose leader is led by another one in a bucket of its own join that one's star.
    """
    sizes = stored(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    shared = stored(buckets.join(sizes, "bucket"))
    weights = stored(shared.groupBy("node").agg(F.sum("n").alias("weight")))
    lead = F.max(F.struct("weight", "node")).alias("lead")
    leaders = stored(shared.join(weights, "node").groupBy("bucket").agg(lead))
    met = shared.join(leaders, "bucket").where("node <> lead.node")
    met = stored(met.select(F.col("lead.weight").alias("w"), F.col("lead.node").alias("u"), F.col("node").alias("v")).distinct())
    hubs = stored(met.groupBy(F.col("v").alias("u")).agg(F.max(F.struct("w", "u")).alias("top")).select("u", F.col("top.u").alias("hub")))
    moved = met.join(hubs, "u", "left").withColumn("hub", F.coalesce("hub", "u"))
    all_ = moved.select("hub", "v").unionByName(moved.select("hub", F.col("u").alias("v"))).where("hub <> v").distinct()
    return stored(all_.join(weights.withColumnRenamed("node", "v"), "v").select(F.col("hub").alias("u"), "v", "weight"))


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` with the classes ``ru, rv`` of both sides."""
    for side in ("u", "v"):
        pairs = pairs.join(roots.select(F.col("u").alias(side), F.col("root").alias(f"r{side}")), side, "left")
        pairs = pairs.withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    return pairs


def _further_leaders(members: DataFrame, sets: DataFrame, found: DataFrame, roots: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links and classes after members outside the class of a large star's hub have met further leaders of their own.

    A star that holds several large classes is so taken apart class by class, as long as a leader links a fair share.
    """
    for _ in range(LEADERS):
        rest = stored(_rooted(members, roots).where("ru <> rv").select("u", "v", "weight", "rv"))
        large = rest.groupBy("u").agg(F.count("*").alias("n"), F.max(F.struct("weight", "v", "rv")).alias("lead")).where(F.col("n") >= LARGE_STAR)
        large = stored(large.select("u", F.col("lead.v").alias("leader"), F.col("lead.rv").alias("led")))
        if large.isEmpty():
            break
        pairs = rest.join(large, "u").where("rv <> led").select(F.col("u").alias("hub"), F.col("leader").alias("u"), "v")
        pairs = stored(pairs)
        linked = alike(pairs.select("u", "v").distinct(), sets, similarity)
        if linked.isEmpty():
            break
        found = found.unionByName(linked)
        roots = stored(components(found))
        told = pairs.join(linked.withColumn("hit", F.lit(1)), ["u", "v"], "left").groupBy("hub").agg((F.count("hit") / F.count("*")).alias("share"))
        # The leader's class is settled within the star; its other members go on.
        members = rest.join(large, "u").where("rv <> led").join(
            told.where(F.col("share") >= WORTHWHILE).select(F.col("hub").alias("u")), "u", "left_semi"
        ).select("u", "v", "weight")
    return found, roots


def _prefixes(rows: DataFrame, similarity: float) -> DataFrame:
    """``(u, token, v, root, far, place, d, m)``: the differences of each member from its hub that a link has to share, rare ones first."""
    c = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [np.empty(0, np.int64)] for k in ("u", "token", "v", "root", "far", "place", "d", "m")}
            for r in batch.to_pylist():
                apart = np.array(r["apart"], np.int64)
                often = dict(zip(r["often"] or [], r["times"] or [], strict=True))
                times = np.array([often.get(t, 0) for t in r["apart"]], np.int64)
                d, n, m = len(apart), r["n"], r["m"]
                # Beside a member that lies outside the hub's class: no fewer than this many differences are shared.
                least = max(1, int(np.ceil((c * n + d - c * m) / 2 - 1e-6)))
                length = d - least + 1
                if r["far"]:
                    length = max(length, min(d, int(c * m * (1 + 1 / similarity) + 1 + 1e-6)))
                chosen = apart[np.lexsort((apart, times))][: max(length, 0)]
                k = len(chosen)
                out["token"].append(chosen)
                out["place"].append(np.arange(1, k + 1))
                for name, value in (("u", r["u"]), ("v", r["v"]), ("root", r["root"]), ("far", int(r["far"])), ("d", d), ("m", m)):
                    out[name].append(np.full(k, value, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out.values()], list(out))

    return stored(rows.mapInArrow(run, "u long, token long, v long, root long, far long, place long, d long, m long"))


def links_in_stars(judged: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All links between members of one star and different classes, exactly.

    Two members are alike if the differences that both have from the hub are many enough, given the sizes, and a member outside the hub's
    class shares over half of the other's. So they share one of the first differences of each, in whatever order; with the rare ones first few pairs do.
    """
    c = (1 - similarity) / (1 + similarity)
    placed = stored(_rooted(judged, roots).select("u", "v", "n", "m", "apart", F.col("rv").alias("root"), (F.col("ru") != F.col("rv")).alias("far")))
    open_ = stored(placed.groupBy("u").agg(F.count("*").alias("size"), F.max("far").alias("far")).where("far and size > 1").select("u", "size"))
    rows = placed.join(open_.select("u"), "u", "left_semi")
    often = rows.select("u", F.explode("apart").alias("token")).groupBy("u", "token").agg(F.count("*").alias("times"))
    often = often.join(open_, "u").where((F.col("times") > 1) & (F.col("times") * COMMON >= F.col("size")))
    often = stored(often.groupBy("u").agg(F.collect_list(F.struct("token", "times")).alias("o")))  # bounded by the share that each token has
    rows = rows.join(often, "u", "left").select("u", "v", "n", "m", "root", "far", "apart", F.col("o.token").alias("often"), F.col("o.times").alias("times"))
    tokens = _prefixes(rows, similarity)
    other = tokens.select("u", "token", *[F.col(k).alias(f"{k}2") for k in ("v", "root", "far", "place", "d", "m")])
    shared = F.greatest(F.lit(1), F.ceil((F.col("d") + F.col("d2") - c * (F.col("m") + F.col("m2"))) / 2 - 1e-6))
    on = (
        (F.col("root") != F.col("root2")) & ((F.col("far2") == 0) | (F.col("v") < F.col("v2")))
        & (F.col("m2") >= similarity * F.col("m") - 1e-6) & (F.col("m") >= similarity * F.col("m2") - 1e-6)
        & (F.col("place") <= F.col("d") - shared + 1) & (F.col("place2") <= F.col("d2") - shared + 1)
    )
    pairs = tokens.where("far = 1").join(other, ["u", "token"]).where(on)
    return alike(stored(pairs.select(F.col("v").alias("u"), F.col("v2").alias("v")).distinct()), sets, similarity)


def _fingerprint_links(docs: DataFrame, rows: DataFrame, radius: int, id_col: str, text_col: str) -> DataFrame:
    """Links ``(u, v)`` from each node to the least one of its class of ``near_duplicates``; ``rows`` holds ``text_hash, node``."""
    fps = stored(fingerprints(docs, id_col, text_col, 3))
    classes = _classes(fps, radius).select("fp", "root")
    texts = fps.select("text_hash", "fp").distinct().join(classes, "fp").select("text_hash", "root")
    held = stored(rows.select("text_hash", "node").distinct().join(texts, "text_hash").select("node", "root").distinct())
    least = held.groupBy("root").agg(F.min("node").alias("v"))
    return stored(held.join(least, "root").where("node <> v").select(F.col("node").alias("u"), "v").distinct())


def similar_classes(
    docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None
) -> DataFrame:
    """``(root, first)``: one row per class of documents whose five-word shingle sets are alike to ``similarity``.

    The search runs over bands of min-hashes. Whether a pair meets in a band depends on its
    similarity alone, not on where or how a text was edited, and a pair at ``similarity`` misses every
    band with a probability of at most ``MISSED``. A pair is a link only if the sets themselves are alike.

    Buckets are gathered in stars (``stars``), whose members are compared with the hub. Members of different classes are then
    compared where the differences that they have from the hub leave room for a link (``links_in_stars``). No pair of a bucket is left
    out, and members that are copies of the hub, edited in different places, do not meet.

    With a ``radius`` the classes of ``near_duplicates``, whose search through the pivot tables is exact, come first: texts whose
    fingerprints lie so near are linked as well, and only members of different classes need to meet in the stars.
    """
    n_rows = band_rows(similarity)
    rows = band_table(docs, id_col, text_col, n_rows)
    if radius is not None:
        rows = stored(rows)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = stored(rows.groupBy("node").agg(F.min(first).alias("first"), F.first("keys").alias("keys")))
    members = stars(nodes.select("node", F.explode("keys").alias("bucket")))
    wanted = members.select(F.col("u").alias("node")).union(members.select("v")).distinct()
    sets = shingle_sets(docs, nodes, wanted, text_col)
    judged = differences(members, sets, similarity)
    found = judged.where("linked").select("u", "v")
    if radius is not None:
        found = found.unionByName(_fingerprint_links(docs, rows, radius, id_col, text_col))
    roots = stored(components(found))
    found, roots = _further_leaders(members, sets, found, roots, similarity)
    linked = links_in_stars(judged, roots, sets, similarity)
    if not linked.isEmpty():
        roots = stored(components(found.unionByName(linked)))
    return nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").groupBy(
        F.coalesce("root", "node").alias("root")
    ).agg(F.min("first").alias("first"))


def keep_one(
    docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None
) -> DataFrame:
    """One document of each class of ``similar_classes``, the one with the smallest id, in the columns of ``docs``.

    Rows that repeat an id and its text are one document. Whole rows are shuffled once.
    """
    kept = stored(similar_classes(docs, similarity, id_col, text_col, radius).select("first.*").drop("no_id"))
    full = docs.select(
        F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(text_col)).alias("hash")
    )
    chosen = full.join(kept, (F.col("id").eqNullSafe(F.col("doc_id"))) & (F.col("hash") == F.col("text_hash")))
    return chosen.groupBy("id", "hash").agg(F.first("row").alias("row")).select("row.*")
