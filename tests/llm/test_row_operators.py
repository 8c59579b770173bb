"""Sharding, exact dedup, packing, WARC and the pipeline against brute force on small rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import io
import random
import time
import zlib

import numpy as np
import pytest
from llm_fixtures import ODD_TEXTS
from oracle_runner import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wattlake.llm import exact_dedup, language_id, packing, queries, sharding, simhash, warc

WORD_BPE = queries.tokenizer_file("word_bpe_49k.json")
CLASHING = ("row", "digest", "keep_id", "group_size", "n", "length", "to", "a.b")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, spark, sf_dir):
    assert compare(queries.QUERIES[name](spark, sf_dir).toArrow(), connect(sf_dir), queries.ORACLES[name]) == []


def check_shards(rows, n, shards):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[i]) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding_has_exact_sizes_and_is_uniform(spark, make, tmp_path):
    docs = make(tmp_path, [f"text {i % 7}" for i in range(1003)], extra=("shard", "row", "file", "position"))
    found = sharding.shard(docs, 24, seed=1, block_rows=10)
    rows = found.collect()
    check_shards(rows, 1003, 24)
    assert sorted(r["doc_id"] for r in rows) == list(range(1003))
    assert {c for c in docs.columns} <= set(found.columns) and len(set(found.columns)) == len(found.columns)
    assert rows == sharding.shard(docs, 24, seed=1, block_rows=10).collect()
    # Neither shard nor place in it follows the id.
    ids = np.array([r["doc_id"] for r in rows])
    for value in ("shard", "slot"):
        assert abs(np.corrcoef(ids, [r[value] for r in rows])[0, 1]) < 0.12


def test_sharding_of_filtered_and_derived_tables(spark, make, tmp_path):
    docs = make(tmp_path, ODD_TEXTS * 5)
    check_shards(sharding.shard(docs.where("doc_id % 3 = 1"), 4).collect(), docs.where("doc_id % 3 = 1").count(), 4)
    check_shards(sharding.shard(docs.groupBy("text").agg(F.max("doc_id").alias("doc_id")), 3).collect(), len(set(ODD_TEXTS)), 3)
    assert sharding.shard(make(tmp_path / "none", []), 24).collect() == []


def test_communication_matrix_adds_up():
    matrix = sharding.communication_matrix([10, 0, 1000, 7], 24, 3)
    assert matrix.sum(1).tolist() == [10, 0, 1000, 7]
    assert matrix.sum(0).tolist() == sharding.shard_sizes(1017, 24).tolist()
    rng = np.random.default_rng(2)
    large = [sharding.hypergeometric(rng, 4 * 10**9, 6 * 10**9, 500) for _ in range(1500)]
    assert abs(np.mean(large) - 200) < 1.5 and abs(np.std(large) - np.sqrt(120)) < 0.8


def test_matrix_of_many_files_follows_the_law():
    began = time.monotonic()
    rows = np.random.default_rng(1).integers(0, 3000, 100_000)
    matrix = sharding.communication_matrix(rows.tolist(), 24, 5)
    assert time.monotonic() - began < 10
    assert (matrix.sum(1) == rows).all() and (matrix.sum(0) == sharding.shard_sizes(int(rows.sum()), 24)).all()
    assert matrix.min() >= 0
    # Files x shards: chi-square of counts against equal shares, 23 degrees of freedom a file.
    full = rows > 500
    chi = ((matrix[full] - rows[full, None] / 24) ** 2 / (rows[full, None] / 24)).sum()
    freedom = 23 * full.sum()
    assert abs(chi - freedom) < 6 * np.sqrt(2 * freedom)


def test_placement_equals_dealing_by_hand(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_FILES", 2)
    docs = make(tmp_path, [f"text {i % 7}" for i in range(900)])
    docs.repartition(7).write.parquet(str(tmp_path / "seven"))
    docs = spark.read.parquet(str(tmp_path / "seven"))
    where = docs.select("doc_id", "_metadata.file_path", "_metadata.row_index", F.xxhash64("_metadata.file_path").alias("h"), F.xxhash64("_metadata.file_path", F.lit(9)).alias("k"))
    files = {}
    for r in where.collect():
        files.setdefault((r["h"] % 4, r["file_path"], r["k"]), {})[r["row_index"]] = r["doc_id"]
    assert len(files) == 7
    totals = [sum(len(v) for (g, _, _), v in files.items() if g == group) for group in range(4)]
    matrix = sharding.communication_matrix(totals, 5, 9)
    next_of, want = matrix.cumsum(0) - matrix, {}
    slot_keys = [r["k"] for r in spark.range(5).select(F.xxhash64(F.col("id").cast("int"), F.lit(10)).alias("k")).collect()]
    for group in range(4):
        mine = sorted((f, k, v) for (g, f, k), v in files.items() if g == group)
        split = sharding.split_rooms(np.array([len(v) for *_, v in mine]), matrix[group], np.random.default_rng([9, group]))
        for (_, k, v), row in zip(mine, split, strict=True):
            order = permute(range(len(v)), len(v), k)
            dealt = [shard for shard, n in enumerate(row) for _ in range(n)]
            taken = sorted((at, v[i]) for i, at in enumerate(order))
            for (_, doc), shard in zip(taken, dealt, strict=True):
                want[doc] = (shard, permute([next_of[group, shard]], matrix[:, shard].sum(), slot_keys[shard])[0])
                next_of[group, shard] += 1
    got = {}
    for limit in (50_000, 0):
        monkeypatch.setattr(sharding, "BROADCAST_FILES", limit)
        got[limit] = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs, 5, seed=9).collect()}
    assert got[50_000] == got[0] == want


def permute(positions, size, key):
    n = np.full(len(positions), size)
    keys = sharding._mix(np.full(len(positions), key, np.int64).astype(np.uint64))
    return sharding.permuted(np.array(positions, np.int64), n, keys).tolist()


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 10, 257, 5000):
        position = np.arange(n)
        for key in (0, 12345):
            found = sharding.permuted(position, np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(found.tolist()) == position.tolist()


def dedup_by_hand(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    return groups


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_dedup(make, tmp_path, counters):
    texts = ODD_TEXTS + ["copy"] * 300 + ["other"] * 100 + [f"single {i}" for i in range(100)]
    docs = make(tmp_path, texts, extra=CLASHING)
    groups = dedup_by_hand(enumerate(texts))
    rows = exact_dedup.outcomes(docs, counters=counters).collect()
    assert len(rows) == len(texts)
    for r in rows:
        group = groups[texts[r["doc_id"]] or ""]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(group), len(group), r["doc_id"] == max(group))
        assert bytes(r["digest"]) == hashlib.sha256((texts[r["doc_id"]] or "").encode()).digest()
    kept = exact_dedup.keep_one(docs, counters=counters)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_exact_dedup_of_repeated_rows_and_null_ids(make, tmp_path):
    docs = make(tmp_path, ["a", "a", "a", "b", "b", None, ""], ids=[1, 1, None, None, None, 4, 4])
    got = {(r["doc_id"], bytes(r["digest"])[:1]): (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.outcomes(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).digest()[:1]
    assert got == {
        (1, sha("a")): (1, 3, True), (None, sha("a")): (1, 3, False), (None, sha("b")): (None, 2, True), (4, sha("")): (4, 2, True)
    }
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in exact_dedup.keep_one(docs).collect()) == [(0, "b"), (1, "a"), (4, "")]
    empty = make(tmp_path / "none", [])
    assert exact_dedup.outcomes(empty).collect() == [] and exact_dedup.keep_one(empty).collect() == []


def test_summaries_find_every_frequent_digest(spark):
    rng = random.Random(4)
    keys = [b"hot"] * 500 + [b"warm"] * 260 + [bytes([i % 256, i // 256]) for i in range(600)]
    rng.shuffle(keys)
    df = spark.createDataFrame([(k, 1) for k in keys], "digest binary, copies long").repartition(7)
    found = {bytes(r[0]) for r in exact_dedup.frequent_digests(df, counters=5).collect()}
    assert {b"hot", b"warm"} <= found and len(found) <= 11


def token_ids(text):
    return Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids + [0]


def check_packing(rows, texts, capacity):
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in texts.items():
        ids, at = token_ids(text), 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r["length"] == capacity or at + r["length"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(sequences)


def test_packing_is_gapless_and_tight(make, tmp_path):
    rng = random.Random(6)
    texts = ODD_TEXTS + ["word " * rng.choice([1, 5, 20, 63, 64, 65, 100, 127, 128, 300]) for _ in range(300)]
    docs = make(tmp_path, texts, extra=CLASHING)
    rows = packing.pack_documents(docs, WORD_BPE, 128).collect()
    used = check_packing(rows, dict(enumerate(texts)), 128)
    bound = -(-sum(r["length"] for r in rows) // 128)
    assert used <= 1.05 * bound + 2
    cut = packing.pieces(docs, WORD_BPE, 128)
    whole = {r["sequence_id"]: r for r in packing.sequences(packing.pack(cut, 128)).collect()}
    assert sum(len(r["ids"]) for r in whole.values()) == 4 * sum(r["length"] for r in rows)


def test_repeated_rows_and_null_ids_are_packed_once_each(make, tmp_path):
    docs = make(tmp_path, ["a b", "a b", "c"], ids=[3, 3, None])
    rows = packing.pack_documents(docs, WORD_BPE, 16).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert packing.pack_documents(make(tmp_path / "none", []), WORD_BPE, 16).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 3000) for _ in range(rng.randint(1, 40))}
    plan = packing.pack_histogram(histogram, 64, rounds=60)
    held = collections.Counter()
    for config, n in plan:
        assert n > 0 and sum(length * copies for length, copies in config.items()) <= 64
        for length, copies in config.items():
            held[length] += copies * n
    assert held == histogram
    bound = max(-(-sum(k * v for k, v in histogram.items()) // 64), sum(v for k, v in histogram.items() if k > 32))
    assert sum(n for _, n in plan) <= 1.3 * bound + len(histogram)


def test_program_holds_most_tokens_and_meets_the_bound():
    """Lengths as in a corpus: most short, few up to the capacity, over a thousand different ones."""
    rng = np.random.default_rng(4)
    drawn = np.minimum(rng.lognormal(5.6, 0.9, 40_000).astype(int) + 1, 2047)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(drawn, return_counts=True), strict=True)}
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[k] for k in lengths.tolist()])
    program, bound = packing.fractional(lengths, demand, 2048)
    held = collections.Counter()
    for config, n in program:
        assert sum(k * c for k, c in config.items()) <= 2048
        for k, c in config.items():
            held[k] += c * n
    assert all(held[k] <= histogram[k] for k in held)
    assert sum(k * n for k, n in held.items()) >= 0.9 * drawn.sum()
    used = sum(n for _, n in packing.pack_histogram(histogram, 2048))
    alone = sum(n for _, n in packing.rounded(histogram, [], 2048))
    through_program = sum(n for _, n in packing.rounded(histogram, packing.first_part(program, 0.5), 2048))
    assert drawn.sum() / 2048 - 1 < bound <= used <= min(alone, through_program) and used <= 1.001 * bound + 1


@pytest.mark.parametrize("seed", range(3))
def test_knapsack_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = np.array(sorted(rng.choice(np.arange(2, 12), 4, replace=False)))
    price = rng.random(4)
    found = packing.best_configuration(lengths, price, 20)
    value = [0.0] * 21
    for room in range(1, 21):
        value[room] = max([value[room - 1], *(value[room - n] + p for n, p in zip(lengths, price, strict=True) if n <= room)])
    assert sum(lengths[i] * c for i, c in found.items()) <= 20
    assert sum(price[i] * c for i, c in found.items()) == pytest.approx(value[20])


def pages(spark, tmp_path, rows):
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string").coalesce(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "", None, "<p>a</p>", "<p>ü\r\n\r\n</p>", "x" * 3_000_000, "<p>a</p>"]
    table = pages(spark, tmp_path, [(i, None if i == 4 else f"http://h/{i}\nx", h, "own") for i, h in enumerate(html)])
    manifest = warc.write_archives(table, "page_id", "url", "html", archive_bytes=400)
    records = warc.read_archives(manifest).collect()
    assert manifest.count() > 1 and sum(r["records"] for r in manifest.collect()) == len(html)
    got = {r["record_id"]: r for r in records}
    first = {}
    for i, h in enumerate(html):
        payload = (h or "").encode()
        r = got[f"<urn:x-page:{i}>"]
        leader = first.setdefault(payload, i)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r["payload_bytes"] == len(payload)
        assert r["record_type"] == ("response" if leader == i else "revisit")
        assert r["refers_to"] == (None if leader == i else f"<urn:x-page:{leader}>")
        assert (r["payload"] is None) == (leader != i) and (leader != i or bytes(r["payload"]) == payload)
        assert (r["target_uri"] is None) == (i == 4)


def test_warc_minimum_size_repeated_rows_and_null_ids(spark, tmp_path):
    table = pages(spark, tmp_path, [(1, "u", "ab", ""), (2, "u", "ab", ""), (5, "u", "abcdef", ""), (5, "u", "abcdef", ""), (None, "u", "abcdef", "")])
    manifest = warc.write_archives(table, "page_id", "url", "html", min_bytes=4)
    kinds = collections.Counter((r["record_id"], r["record_type"]) for r in warc.read_archives(manifest, payloads=False).collect())
    assert kinds == {
        ("<urn:x-page:1>", "response"): 1, ("<urn:x-page:2>", "response"): 1, ("<urn:x-page:5>", "response"): 2,
        ("<urn:x-page:>", "revisit"): 1,
    }
    assert warc.read_archives(warc.write_archives(pages(spark, tmp_path / "none", []), "page_id", "url", "html")).collect() == []


def test_warc_reader_rejects_what_does_not_hold():
    good = warc.page_record("1", "http://h/", b"payload", warc.sha1_base32(b"payload"), None, "1970-01-01T00:00:00Z")
    assert len(list(warc.read_records(io.BytesIO(good + good)))) == 2
    bad = warc.page_record("1", "http://h/", b"payload", warc.sha1_base32(b"other"), None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="match"):
        list(warc.read_records(io.BytesIO(bad)))
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.read_records(io.BytesIO(good[:-9])))
    with pytest.raises(ValueError, match="framed"):
        warc.parse(zlib.decompress(good, 31).replace(b"payload\r\n\r\n", b"payload and more\r\n\r\n"))


def test_pipeline_stages_by_brute_force(spark, make, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    base = [" ".join(word() for _ in range(150)) for _ in range(30)]
    near = [f"{t} {word()}" for t in base[:10]]
    texts = [*base, *base[:5], *near, None, "", "123 456", "a", "b"]
    langs = [("en", "de", None)[i % 3] for i in range(len(texts))]
    docs = make(tmp_path, texts, langs=langs)
    columns = docs.columns
    step = docs
    wanted = {i: t for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    after = []
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
        after.append(step)
    told = {r["doc_id"] for r in after[0].collect()}
    assert told == set(wanted) and after[0].columns == columns
    last = {t: i for i, t in sorted(wanted.items())}
    assert {r["doc_id"] for r in after[1].collect()} == set(last.values()) and after[1].columns == columns
    kept = {r["doc_id"] for r in after[2].collect()}
    groups = [{last[t], last[n]} for t, n in zip(base[:10], near, strict=True)]
    assert all(len(g & kept) == 1 and min(g) in kept for g in groups)
    assert kept == set(last.values()) - {max(g) for g in groups} and after[2].columns == columns
    check_packing(after[3].collect(), {i: texts[i] for i in kept}, 2048)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        map(tuple, after[3].select("doc_id", "piece", "ids_crc32").collect())
    )


@pytest.mark.parametrize("run", [language_id.keep_known, exact_dedup.keep_one, simhash.keep_one])
def test_stages_keep_clashing_columns(make, tmp_path, run):
    docs = make(tmp_path, ODD_TEXTS, extra=("row", "id", "hash", "doc_id2", "root", "u"))
    found = run(docs)
    assert found.columns == docs.columns
    assert all(r["row"] == f"own {r['doc_id']}" for r in found.collect())
