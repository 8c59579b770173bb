"""License scan, token counts, BPE, fingerprints, SimHash and language ID against brute force on small rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from llm_fixtures import ODD_TEXTS
from tokenizers import Tokenizer

from wattlake.llm import bpe, fingerprints, language_id, license_scan, queries, simhash, token_counts
from wattlake.llm.common import documents

BYTE_BPE = queries.tokenizer_file("byte_bpe_50k.json")
CLASHING = ("row", "shard", "slot", "digest", "hash", "fp", "n", "a.b")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def license_windows(text):
    """Every window of every template from every word, and of those that overlap the best."""
    words = re.findall("[a-z0-9]+", (text or "").lower())
    run = [f"{a} {b}" for a, b in zip(words, words[1:])]
    best = set()
    for key, grams, size, _ in license_scan.window_templates(license_scan.templates(), 0.8):
        found = []
        for p in range(len(run)):
            cut = set(run[p : p + size - 1])
            if run[p] in grams:
                found.append((-2.0 * len(cut & set(grams)) / (len(cut) + len(grams)), -size, key, p + 1))
        if found and min(found)[0] <= -0.8:
            best.add(min(found))
    beaten = lambda x: any(y < x and y[3] < x[3] - x[1] and x[3] < y[3] - y[1] for y in best)
    return {(x[2], x[3], -x[0]) for x in best if not beaten(x)}


def wrapped(text, width, mark):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines, line = [*lines, mark + line], ""
        line += " " + word
    return "\n".join([*lines, mark + line])


def test_license_windows_find_wrapped_and_inline_notices(make, tmp_path):
    code = "import os\n\n\ndef f(x):\n    return x + 1\n" * 30
    heads = {key: code + wrapped(text, 60, "# ") + "\n" + code for key, text in license_scan.TEXTS.items()}
    inline = [
        ("MIT", "This file is part of Foo and is licensed under the MIT License."),
        ("MIT", "Copyright 2020 Jane Doe. Licensed under the MIT License. See LICENSE for details."),
        ("Apache-2.0", "All of it is, to be clear, licensed under the\n * Apache License,\n * Version 2.0, as are its parts."),
    ]
    clean = ["Permission was granted to the person in the photograph, who is under the impression of the weather. " * 40]
    two = license_scan.TEXTS["GPL-2.0"] + " and so on " * 90 + license_scan.TEXTS["GPL-3.0"]
    texts = [*heads.values(), *[t for _, t in inline], *clean, two, *ODD_TEXTS, "under the " * 3000 + "Licensed under the MIT License " * 300]
    rows = license_scan.scan(make(tmp_path, texts, extra=CLASHING)).where("unit = -1").collect()
    got = {i: {(r["license"], r["word"], r["dice"]) for r in rows if r["doc_id"] == i} for i in range(len(texts))}
    assert got == {i: license_windows(t) for i, t in enumerate(texts)}
    assert len(rows) == sum(map(len, got.values()))
    for i, key in enumerate([*heads, *[k for k, _ in inline]]):
        assert {k for k, *_ in got[i]} == {key}
    assert got[len(heads) + len(inline)] == set()
    assert {k for k, *_ in got[len(heads) + len(inline) + 1]} == {"GPL-2.0", "GPL-3.0"}


def test_license_scan_of_repeated_rows_and_ties(make, tmp_path):
    rows = license_scan.scan(make(tmp_path, ["Licensed under MIT\n"] * 2 + ["x"], ids=[1, 1, None])).collect()
    assert sorted((r["doc_id"], r["unit"]) for r in rows) == [(1, u) for u in (-1, -1, 0, 0, 1, 1)]
    tied = license_scan.scan(make(tmp_path / "tied", ["some words of two"]), [("B", "some words of two"), ("A", "some words of two")])
    assert {(r["unit"], r["license"]) for r in tied.collect()} == {(-1, "A"), (0, "A"), (1, "A")}


def test_license_scan_finds_lines_and_whole_texts(make, tmp_path):
    mit = license_scan.TEXTS["MIT"]
    changed = mit.replace("Software", "Program", 2)
    texts = [*ODD_TEXTS, mit, changed.replace("\n", " "), "Licensed under CC BY-NC 4.0.", "Words, then\nReleased under the Apache License, Version 2.0!"]
    docs = make(tmp_path, texts, extra=CLASHING)
    got = {(r["doc_id"], r["unit"]): (r["license"], r["dice"]) for r in license_scan.scan(docs).collect()}
    want = {}
    sets = license_scan.bigram_sets(license_scan.templates())
    for i, text in enumerate(texts):
        for unit, part in enumerate([text or "", *(text or "").split("\n")]):
            grams = set(license_scan.template_bigrams(part))
            best = min(((-2.0 * len(grams & set(g)) / (len(grams) + len(g)), key) for key, g in sets), default=(0, ""))
            if grams and -best[0] >= 0.8:
                want[i, unit] = (best[1], -best[0])
        for key, _, dice in license_windows(text):
            want[i, -1] = (key, dice)
    assert got == want
    assert got[len(ODD_TEXTS), 0] == ("MIT", 1.0)
    assert 0.8 < got[len(ODD_TEXTS) + 1, 0][1] < 1.0


def test_license_scan_keeps_units_exactly_at_the_threshold(make, tmp_path):
    texts = ["Licensed under MIT", "Licensed under ISC"]
    got = {(r["doc_id"], r["unit"]): (r["license"], r["dice"]) for r in license_scan.scan(make(tmp_path, texts)).collect()}
    assert got == {(i, unit): (name, 0.8) for i, name in enumerate(("MIT", "ISC")) for unit in (-1, 0, 1)}
    # Every size of unit and template that can reach 0.8 exactly, with words of its own.
    sizes = [(n, t) for n in range(2, 40) for t in range(2, 40) if 2 * min(n, t) == 0.8 * (n + t) or (n + t) % 5 == 0 and 0.4 * (n + t) <= min(n, t)]
    table, texts = [], []
    for k, (n, t) in enumerate(sizes):
        shared = round(0.4 * (n + t))
        common = [f"w{k}x{i}" for i in range(shared + 1)]
        table.append((f"L{k:04d}", " ".join(common + [f"t{k}x{i}" for i in range(t - shared)])))
        texts.append(" ".join(common + [f"u{k}x{i}" for i in range(n - shared)]))
    found = license_scan.scan(make(tmp_path / "sizes", texts), table)
    got = {(r["doc_id"], r["license"], r["dice"]) for r in found.where("unit = 0").collect()}
    assert got == {(k, f"L{k:04d}", 0.8) for k in range(len(sizes))}


def test_token_counts_equal_the_library(make, tmp_path):
    docs = make(tmp_path, ODD_TEXTS, extra=CLASHING)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    got = by_id(token_counts.with_counts(docs, BYTE_BPE, table_size=4))
    for i, text in enumerate(ODD_TEXTS):
        assert got[i]["n_tokens"] == len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert got[i]["n_bytes"] == len((text or "").encode())
        assert got[i]["row"] == f"own {i}"


def test_bpe_round_trip_equals_the_library(make, tmp_path):
    rng = random.Random(3)
    letters = "abcdefgh éß'\n\t .,0123😀日"
    texts = ODD_TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    docs = make(tmp_path, texts, extra=CLASHING)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    got = by_id(bpe.encode(docs, BYTE_BPE))
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[i]["token_ids"] == ids
        assert got[i]["decoded"] == tokenizer.decode(ids, skip_special_tokens=False) == (text or "")


def test_short_and_long_words_merge_alike():
    code = bpe.Codec(BYTE_BPE)
    words = ["".join(random.Random(i).choice("abcdetionghr") for _ in range(1 + i % 48)).encode() for i in range(200)]
    assert code.encode_short(words) == [code.encode_long(w) for w in words]


def shingle_set(text):
    words = [w for w in re.split(r"\s+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprint_edits_and_likeness(make, tmp_path):
    rng = random.Random(1)
    texts = ODD_TEXTS + [" ".join(str(rng.randint(0, 5000)) for _ in range(rng.randint(30, 900))) for _ in range(60)]
    ids = rng.sample(range(10_000), len(texts))
    docs = make(tmp_path, texts, ids=ids, extra=CLASHING)
    found = fingerprints.fingerprint_edits(docs)
    found = found.withColumn("near", fingerprints.likeness(found.fp, found.edited_fp)).withColumn(
        "next", fingerprints.likeness(found.fp, found.next_fp)
    )
    got = by_id(found)
    order = sorted(ids, reverse=True)
    text_of = {i: t or "" for i, t in zip(ids, texts, strict=True)}
    errors, prints = [], {}
    for at, i in enumerate(order):
        following = order[(at + 1) % len(order)]
        text = text_of[i]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + text_of[following][:cut]
        assert got[i]["edited"] == edited and got[i]["n_chars"] == len(text)
        assert prints.setdefault(text, got[i]["fp"]) == got[i]["fp"]
        a, b = shingle_set(text), shingle_set(edited)
        if len(a) > 20:
            errors.append(got[i]["near"] - len(a & b) / len(a | b))
        if got[i]["fp"] == got[following]["fp"]:
            assert got[i]["next"] == 1.0
        assert 0.0 <= got[i]["near"] <= 1.0
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    assert got[ids[0]]["fp"] == [] and got[ids[1]]["fp"] == []


def test_fingerprints_with_repeated_and_null_ids(make, tmp_path):
    docs = make(tmp_path, ["a b c", "a b c", "d e f", None, "g"], ids=[5, 5, 5, None, 1])
    rows = fingerprints.fingerprint_edits(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]) for r in rows) == [
        (False, 1, 1), (False, 5, 5), (False, 5, 5), (False, 5, 5), (True, 0, 0)
    ]
    # The ring is 5, 1, null: an id with two texts stands for the one with the larger hash.
    edited = {(r["doc_id"], r["n_chars"]): r["edited"] for r in rows}
    assert edited[1, 1] == "g" and edited[None, 0] == ""
    single = make(tmp_path / "one", ["abc def"])
    assert single.count() == 1 and fingerprints.fingerprint_edits(single).first()["edited"] == "abc dab"


def simhash_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def test_simhash_classes_equal_brute_force(make, tmp_path):
    rng = random.Random(5)
    base = [str(rng.randint(0, 900)) for _ in range(250)]
    copies = []
    for _ in range(120):
        words = list(base)
        for at in rng.sample(range(250), rng.randint(0, 2)):
            words[at] = "changed"
        copies.append(" ".join(words))
    texts = ODD_TEXTS + copies
    docs = make(tmp_path, texts, extra=CLASHING)
    got = by_id(simhash.near_duplicates(docs))
    fps = {i: simhash_of(t) for i, t in enumerate(texts)}
    assert {i: r["fp"] & (2**64 - 1) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == classes_of(fps)


def test_links_of_a_large_block_equal_brute_force(spark):
    rng = random.Random(9)
    center = rng.getrandbits(64)
    fps = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(0, f) for f in signed], "view int, fp long")
    edges = [(r["u"], r["v"]) for r in simhash.links(df).collect()]
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 2 for u, v in edges)
    rank = {f: i for i, f in enumerate(sorted(signed))}
    want = classes_of({rank[f]: f & (2**64 - 1) for f in signed})
    from wattlake.llm.components import components

    roots = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {rank[f]: rank[roots.get(f, f)] for f in signed} == want


def test_near_duplicate_stage_links_what_the_pivot_search_links(spark, make, tmp_path):
    """Also texts within two bits whose shingle sets are less alike than the stage's own search asks for."""
    rng = random.Random(4)
    texts: list[str] = []
    while len(texts) < 12:
        base = [str(rng.randint(0, 900)) for _ in range(60)]
        words = list(base)
        for at in rng.sample(range(60), 2):
            words[at] = "changed"
        pair = [" ".join(base), " ".join(words)]
        if (simhash_of(pair[0]) ^ simhash_of(pair[1])).bit_count() <= 2 and jaccard(*pair) < 0.8:
            texts += pair
    docs = make(tmp_path, [*ODD_TEXTS, *texts])
    linked = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, str(tmp_path)).collect()}
    assert kept <= linked and set(range(len(ODD_TEXTS), len(ODD_TEXTS) + 12, 2)) <= kept


def test_near_duplicate_stage_keeps_one_of_each_class(make, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, group = [], []
    for g in range(40):
        base = [word() for _ in range(200)]
        for c in range(1 + g % 4):
            words = list(base)
            if c:
                words[rng.randrange(200)] = word()
            texts.append(" ".join(words))
            group.append(g)
    docs = make(tmp_path, texts + texts[:1], ids=[*range(len(texts)), 0], extra=("node", "row", "hash"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids))
    first = {group.index(g) for g in range(40)}
    assert first <= set(ids)  # the smallest id of each class, and all documents without copies
    assert set(ids) == first


def edited_copies(rng, word, kinds, low=0.82, high=0.9):
    """``(base, copy)`` texts of 600 words with a passage appended, cut off or replaced, at a similarity between the bounds."""
    out = []
    for k in range(kinds * 3):
        base = [word() for _ in range(600)]
        j = rng.uniform(low, high)
        n = round(600 * (1 - j)) if k % 3 else round(600 * (1 / j - 1))
        if k % 3 == 0:
            copy = base + [word() for _ in range(n)]
        elif k % 3 == 1:
            copy = base[: 600 - n]
        else:
            n = round(600 * (1 - j) / (1 + j)) - 5
            at = rng.randrange(600 - n)
            copy = base[:at] + [word() for _ in range(n)] + base[at + n :]
        out.append((" ".join(base), " ".join(copy)))
    return out


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_near_duplicate_search_finds_added_cut_and_replaced_passages(make, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    pairs = edited_copies(rng, word, 20)
    assert all(jaccard(a, b) >= 0.8 for a, b in pairs)
    rows = simhash.band_rows(0.8)
    assert (1 - 0.8**rows) ** (simhash.MIN_HASHES // rows) <= 1e-5
    keys = lambda t: simhash.band_keys(simhash.min_hashes(simhash.shingles(t.encode())), rows)
    assert all((keys(a) == keys(b)).any() for a, b in pairs)
    kept = {r["doc_id"] for r in simhash.keep_one(make(tmp_path, [t for pair in pairs for t in pair])).collect()}
    assert not kept & set(range(1, 2 * len(pairs), 2))


def test_near_duplicate_links_are_decided_by_the_sets(make, tmp_path):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    texts = [" ".join(base)]
    while len(texts) < 60:  # all near the threshold, none with a partner that reaches it
        words = list(base)
        for at in rng.sample(range(200), 5):
            words[at] = word()
        text = " ".join(words)
        if jaccard(text, texts[0]) > 0.6 and all(jaccard(text, t) < 0.8 for t in texts):
            texts.append(text)
    # Exactly at the threshold: 8 of 10 shingles shared.
    texts += [" ".join(word() for _ in range(14))]
    texts += [" ".join(texts[-1].split()[:12])]
    assert jaccard(texts[-1], texts[-2]) == 0.8
    kept = {r["doc_id"] for r in simhash.keep_one(make(tmp_path, texts)).collect()}
    assert kept == set(range(len(texts) - 1))


def test_near_duplicate_classes_of_a_large_group_equal_brute_force(make, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(200)], []
    for _ in range(400):
        words = list(base)
        for at in rng.sample(range(200), rng.randint(3, 6)):
            words[at] = word()
        texts.append(" ".join(words))
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for k in range(i):
            if len(a & sets[k]) / len(a | sets[k]) >= 0.8:
                low, high = sorted((find(i), find(k)))
                root[high] = low
    kept = {r["doc_id"] for r in simhash.keep_one(make(tmp_path, texts)).collect()}
    assert kept == {find(i) for i in range(len(texts))}


def test_language_id(spark, sf_dir, make, tmp_path):
    docs = documents(spark, "/root/testdata/sf0.01")
    model = language_id.learn(docs.where(language_id.fold() != 0))
    told = docs.select("doc_id", "lang", (language_id.fold() == 0).alias("held"), language_id.predict(docs, model).alias("t")).collect()
    held = [r for r in told if r["held"]]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in told)
    assert np.mean([r["t"]["lang"] == r["lang"] for r in held]) > 0.97
    odd = make(tmp_path, ODD_TEXTS, extra=CLASHING)
    got = {r["doc_id"]: r["t"] for r in odd.select("doc_id", language_id.predict(odd, model).alias("t")).collect()}
    for i, text in enumerate(ODD_TEXTS):
        assert (got[i]["lang"] == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0.0 <= got[i]["score"] <= 1.0
    # Two languages in one document: both are in its mixture.
    by_lang = {lang: " ".join(r["text"] for r in docs.where(docs.lang == lang).limit(3).collect())[:3000] for lang in ("en", "de")}
    share, _ = language_id.infer(by_lang["en"] + " " + by_lang["de"], model[1])
    shares = dict(zip(model[0], share, strict=True))
    assert shares["en"] > 0.3 and shares["de"] > 0.3 and shares["fr"] < 0.1


def test_language_id_without_labels(make, tmp_path):
    docs = make(tmp_path, ["some words", None], langs=[None, None])
    model = language_id.learn(docs)
    assert model[0] == []
    assert [r[0]["lang"] for r in docs.select(language_id.predict(docs, model)).collect()] == ["und", "und"]


def test_documents_stay_without_any_label(spark, make, tmp_path):
    texts = ["some clean words", "weitere saubere Wörter", None, "123 456"]
    for name, langs, ids in (("none", [None] * 4, range(4)), ("held", ["en", None, None, None], [6, 0, 1, 2])):
        docs = make(tmp_path / name, texts, ids=list(ids), langs=langs)
        if name == "held":  # the only label is in fold 0
            assert docs.where("lang IS NOT NULL").where(language_id.fold() != 0).count() == 0
        assert {r["text"] for r in language_id.keep_known(docs).collect()} == set(texts[:2])
    step = make(tmp_path / "pipeline", texts, langs=[None] * 4)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "pipeline")).collect()} == {0, 1} and step.count() == 4


def test_text_unlike_every_learned_language_goes(spark):
    rows = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    rng = random.Random(3)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400))
    odd = ["これは日本語の文章です。" * 5, "Это предложение на русском языке. " * 5, noise, "日本"]
    extra = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], rows.schema)
    gone = set(rows.unionByName(extra).select("doc_id").toPandas()["doc_id"]) - set(
        language_id.keep_known(rows.unionByName(extra)).select("doc_id").toPandas()["doc_id"])
    letters = {r["doc_id"]: any(c.isalpha() for c in r["text"] or "") for r in rows.collect()}
    assert gone == {-1, -2, -3} | {i for i, has in letters.items() if not has}


@pytest.mark.parametrize("run", [
    license_scan.scan, lambda d: token_counts.with_counts(d, BYTE_BPE), lambda d: bpe.encode(d, BYTE_BPE),
    fingerprints.fingerprint_edits, simhash.near_duplicates, simhash.keep_one, language_id.keep_known,
])
def test_empty_table(make, tmp_path, run):
    assert run(make(tmp_path, [])).collect() == []


def plain_mixture(text, table):
    """The best mixture of all languages, one row per trigram of the text, in plain Python."""
    data = f" {text.lower()} ".encode()
    rows = [table[int(language_id.trigrams(data[i : i + 3])[0])] for i in range(len(data) - 2)]
    share = [1.0 / table.shape[1]] * table.shape[1]
    for _ in range(language_id.ITERATIONS):
        new = [0.0] * len(share)
        for row in rows:
            whole = sum(s * p for s, p in zip(share, row, strict=True))
            for k, s in enumerate(share):
                new[k] += s * row[k] / whole / len(rows)
        moved, share = max(abs(a - b) for a, b in zip(share, new, strict=True)), new
        if moved < 1e-3:
            break
    return share, sum(math.log(sum(s * p for s, p in zip(share, row, strict=True))) for row in rows)


@pytest.mark.parametrize("text", ["a", "the house of the rising sun " * 3, "das ist ein haus and this is not äö中"])
def test_mixture_of_distinct_trigrams_is_that_of_all(text):
    table = np.random.default_rng(5).dirichlet([0.3] * (1 << language_id.BITS), 3).T + 1e-9
    grams, times = language_id.distinct(text)
    share, likelihood = language_id.mixture(table[grams], times, np.full(3, 1 / 3))
    wanted, wanted_likelihood = plain_mixture(text, table)
    assert np.allclose(share, wanted) and math.isclose(likelihood, wanted_likelihood, rel_tol=1e-9)


def test_trigrams_of_a_very_long_text_are_counted_in_blocks():
    text = "".join(f"word{i} " for i in range(500_000))  # over 5 MB, several blocks
    grams, times = language_id.distinct(text)
    whole = np.bincount(language_id.trigrams(f" {text} ".encode()), minlength=1 << language_id.BITS)
    assert len(text) > 5_000_000 and times.sum() == len(text) and (whole[grams] == times).all()
    table = np.full((1 << language_id.BITS, 2), 2.0**-language_id.BITS)
    table[grams[:50], 0] *= 2
    tracemalloc.start()
    share, _ = language_id.infer(text, table)
    assert tracemalloc.get_traced_memory()[1] < 60_000_000 and share.argmax() == 0
    tracemalloc.stop()


def test_near_duplicate_classes_of_alike_families_equal_brute_force_with_few_pairs(make, tmp_path, monkeypatch):
    """Families so alike that they share buckets, most members further than 0.8 from each other."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))

    def edited(words, n):
        out = list(words)
        for at in rng.sample(range(len(out)), n):
            out[at] = word()
        return out

    root_text, sets = [word() for _ in range(150)], []
    texts = []
    for _ in range(3):
        base = edited(root_text, 5)
        texts += [" ".join(edited(base, rng.randint(2, 7))) for _ in range(90)]
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for k in range(i):
            if len(a & sets[k]) / len(a | sets[k]) >= 0.8:
                low, high = sorted((find(i), find(k)))
                root[high] = low
    judged, sides = [], simhash._sides
    monkeypatch.setattr(simhash, "_sides", lambda pairs, found: judged.append(pairs.count()) or sides(pairs, found))
    kept = {r["doc_id"] for r in simhash.keep_one(make(tmp_path, texts)).collect()}
    assert kept == {find(i) for i in range(len(texts))}
    assert sum(judged) <= 30 * len(texts)  # of 36,315 pairs
