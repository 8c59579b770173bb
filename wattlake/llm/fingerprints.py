"""Document fingerprints: one-permutation MinHash in packed low-order bits, as column expressions.

Each shingle is hashed once. The top bits of the hash name a bin, and each bin
keeps its least hash. An empty bin takes the value of another one by optimal
densification: it probes bins in a pseudo-random order of its own, the same for all
documents, until one is filled. Of each bin the low ``BITS`` bits are stored, and
since unrelated values agree in them by chance once in ``2 ** BITS`` times, the
share of equal bins is corrected for that.

All of it is built-in functions on the document's own arrays: no explode, no
shuffle and no Python.

Defined cases: a null text counts as the empty text; a text without words has an
empty fingerprint, which is like another empty one (1) and unlike any other (0);
fewer words than a shingle are one shingle; repeated shingles count once;
texts of any length are hashed whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlake.llm.common import stored, text_of

WORDS = 5
#: Bins, a power of two and a multiple of the bins in one long.
BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 4
PER_LONG = 64 // BITS
#: Probes of an empty bin before all bins are put in its order at once.
PROBES = 12


def _bin(h: Column) -> Column:
    """Bin of a hash; ascending in the signed order of the hashes."""
    return (F.shiftright(h, 64 - BIN_BITS) + BINS // 2).cast("int")


def with_fingerprint(df: DataFrame, text: str, out: str, words: int = WORDS) -> DataFrame:
    """``df`` with ``out``: the fingerprint of column ``text`` as an array of longs, empty without words.

    Temporary columns are named after ``out``; steps are separate columns so that none is computed twice.
    """
    w, s, m, d, f = (f"{out}__{step}" for step in ("words", "sorted", "minima", "dense", "full"))
    hashed = F.transform(F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda x: x != ""), lambda x: F.xxhash64(x))
    df = df.withColumn(w, hashed)
    n = F.size(w)
    shingles = F.transform(
        F.sequence(F.lit(1), F.greatest(n - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(F.col(w), i, words))
    )
    df = df.withColumn(s, F.when(n > 0, F.sort_array(shingles)).otherwise(F.array().cast("array<long>")))
    df = df.withColumn(
        m, F.filter(F.col(s), lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(s), i - 1))))
    )
    none = F.lit(None).cast("long")
    gap = lambda x, i: F.coalesce(_bin(F.get(F.col(m), i + 1)), F.lit(BINS)) - _bin(x) - 1
    # Each least hash, followed by a null for every empty bin up to the next one.
    dense = F.concat(
        F.array_repeat(none, _bin(F.get(F.col(m), F.lit(0)))),
        F.flatten(F.transform(F.col(m), lambda x, i: F.concat(F.array(x), F.array_repeat(none, gap(x, i))))),
    )
    df = df.withColumn(d, dense)

    def densified(x: Column, i: Column) -> Column:
        probe = lambda t: F.get(F.col(d), F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int"))
        order = F.array_min(
            F.transform(F.col(m), lambda y: F.struct(F.xxhash64(i, _bin(y)).alias("order"), y.alias("value")))
        )
        return F.coalesce(x, *[probe(t) for t in range(PROBES)], order["value"])

    df = df.withColumn(f, F.transform(F.col(d), densified))
    low = lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1)))
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)),
        lambda j: F.aggregate(F.slice(F.col(f), j * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"), low),
    )
    return df.withColumn(out, F.when(n > 0, packed).otherwise(F.array().cast("array<long>"))).drop(w, s, m, d, f)


def as_text(fp: Column) -> Column:
    """Fingerprint as lowercase hex digits."""
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, from 0 to 1."""

    def unequal(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    equal = 1.0 - reduce(lambda p, q: p + q, [unequal(i) for i in range(BINS // PER_LONG)]) / float(BINS)
    chance = 1.0 / (1 << BITS)
    corrected = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (equal - chance) / (1.0 - chance)))
    empty = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(empty == 2, 1.0).when(empty == 1, 0.0).otherwise(corrected)


def neighbours(heads: DataFrame) -> DataFrame:
    """``(doc_id, next, prev)``: the rows of ``heads`` after and before each row in descending order of id, in a ring.

    A null id comes last. Rows are sorted by range; each range finds its
    neighbours on its own, and one row per range settles the seams.
    """
    value = F.struct(*heads.columns)
    ranges = stored(
        heads.repartitionByRange(F.col("doc_id").desc_nulls_last()).withColumn("part", F.spark_partition_id())
    )
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last())
    linked = ranges.select(
        "part", "doc_id", F.lead(value).over(inside).alias("next"), F.lag(value).over(inside).alias("prev"),
        value.alias("self"),
    )
    # Ranges are as many as shuffle partitions, so their seams are few rows.
    seams = linked.where("next IS NULL OR prev IS NULL").groupBy("part").agg(
        F.first(F.when(F.col("prev").isNull(), F.col("self")), ignorenulls=True).alias("head"),
        F.first(F.when(F.col("next").isNull(), F.col("self")), ignorenulls=True).alias("tail"),
    )
    order = Window.orderBy("part")
    ring = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seams = seams.select(
        "part",
        F.coalesce(F.lead("head").over(order), F.first("head").over(ring)).alias("next_head"),
        F.coalesce(F.lag("tail").over(order), F.last("tail").over(ring)).alias("prev_tail"),
    )
    return linked.join(F.broadcast(seams), "part").select(
        "doc_id", F.coalesce("next", "next_head").alias("next"), F.coalesce("prev", "prev_tail").alias("prev")
    )


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text ends with the beginning of the next document in descending order of id (the
    last one takes the first) in place of its own last third. Rows that repeat an id all give a row;
    as a neighbour an id stands for its text of the largest hash.

    Returns ``(doc_id, n_chars, edited, fp, edited_fp, next_fp)``, fingerprints as arrays. Texts are
    shuffled once, and of each a third as the end of its neighbour.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text")).withColumn(
        "hash", F.xxhash64("text")
    )
    own = stored(
        with_fingerprint(rows, "text", "fp", words).select("doc_id", "hash", F.length("text").cast("long").alias("n_chars"), "fp")
    )
    heads = own.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"), F.max(F.struct("hash", "fp")).alias("as_next"))
    ring = stored(
        neighbours(heads).select(
            "doc_id",
            F.col("next.as_next.fp").alias("next_fp"),
            F.col("prev.doc_id").alias("prev_id"),
            F.floor(F.col("prev.n_chars") / 3).cast("int").alias("wanted"),
        )
    )
    given = (
        rows.alias("r").join(ring.alias("g"), F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")))
        .select("prev_id", "hash", F.substring("text", F.lit(1), F.col("wanted")).alias("ending"))
        .groupBy("prev_id").agg(F.max(F.struct("hash", "ending")).alias("given"))
    )
    prints = own.groupBy("doc_id", "hash").agg(F.first("fp").alias("fp"))
    # Hashes are compared by their difference, so that the id alone stays the key of the join.
    edited = (
        rows.alias("r")
        .join(given.alias("g"), F.col("r.doc_id").eqNullSafe(F.col("g.prev_id")))
        .join(ring.alias("n"), F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")))
        .join(prints.alias("p"), F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("r.hash").bitwiseXOR(F.col("p.hash")) == 0))
        .select("r.doc_id", "text", F.length("text").alias("n_chars"), F.col("given.ending").alias("ending"), "fp", "next_fp")
    )
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = edited.withColumn(
        "edited",
        F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut), F.substring("ending", F.lit(1), cut)),
    ).drop("text", "ending")
    return with_fingerprint(edited, "edited", "edited_fp", words)
