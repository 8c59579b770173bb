"""Lexical search, collocations and the quality classifier against brute force on small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import ODD_TEXTS

from wattlake.llm import collocations, lexical_search, quality
from wattlake.llm import queries as registered

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def term_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranking(docs, items, top=10):
    """``{(item, rank): (doc, score)}`` by scoring every document for every item."""
    bags = [(i, Counter(term_list(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    rows = []
    for item, text in items:
        found = []
        for (doc, bag), n in zip(bags, sizes, strict=True):
            score = 0
            for term in term_list(text):
                if term in bag:
                    m = 100 - 75 + (75 * n * n_docs) // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * ((1000000000 * bag[term]) // (1000 * bag[term] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc))
        rows += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(rows, key=str)


def random_texts(rng, n, words="alpha beta gamma delta eps zeta eta theta iota kappa".split()):
    return [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(n)]


@pytest.fixture()
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string, doc_id string, score string")


def test_lexical_search_equals_scoring_every_document(spark, make, items, tmp_path):
    rng = np.random.default_rng(3)
    texts = random_texts(rng, 300) + ["Alpha-beta GAMMA"] * 60 + ODD_TEXTS + ["long " * 300_000 + "kappa"]
    ids = [None, *(int(i) for i in rng.permutation(len(texts) - 1))]
    docs = make(tmp_path, texts, ids, extra=("item_id", "score", "bag", "n"))
    asked = [(0, "alpha beta beta", "x", "y"), (1, "GAMMA iota unknown", "x", "y"), (2, None, "x", "y"), (3, "...", "x", "y"), (3, "kappa ½ naïve", "x", "y"), (4, "mit license", "x", "y")]
    got = lexical_search.search(docs, items(asked))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == ranking(list(zip(ids, texts, strict=True)), [a[:2] for a in asked])


def test_lexical_search_in_blocks_gives_the_same_rows(spark, make, items, tmp_path):
    rng = np.random.default_rng(4)
    texts = random_texts(rng, 80)
    docs = make(tmp_path, texts)
    asked = [(i, t, "", "") for i, t in enumerate(random_texts(rng, 9))] + [(0, random_texts(np.random.default_rng(4), 90)[-9], "", "")]
    whole = sorted(map(tuple, lexical_search.search(docs, items(asked)).collect()))
    parts = sorted(map(tuple, lexical_search.search(docs, items(asked), block_terms=5).collect()))
    assert whole == parts
    assert whole == sorted(ranking(list(enumerate(texts)), {(a[0], tuple(sorted(term_list(a[1])))): a[:2] for a in asked}.values()))


def test_lexical_search_of_empty_tables(spark, make, items, tmp_path):
    none = make(tmp_path, [])
    assert lexical_search.search(none, items([(1, "a", "", "")])).count() == 0
    assert lexical_search.search(make(tmp_path, ["a b"]), items([])).count() == 0
    assert lexical_search.search(make(tmp_path, [None, "..."]), items([(1, "a", "", "")])).count() == 0


def test_scores_beyond_doubles_stay_exact():
    weights = np.array([27_000, 3], np.int64)
    block = [([0, 1], [20_000_000, 1]), ([1], [7])]
    postings = lexical_search.Postings(block, weights)
    assert not postings.exact
    flat = np.array([[0, 3], [1, 2], [1, 5]], np.int32)
    got = postings.scores(flat, np.array([2, 1]), np.array([40, 90]))
    value = lambda tf, m: (10**9 * tf) // (1000 * tf + 8 * m)
    assert got.tolist() == [
        [20_000_000 * 27_000 * value(3, 40) + 3 * value(2, 40), 21 * value(2, 40)], [3 * value(5, 90), 21 * value(5, 90)],
    ]


def phrase_table(docs, least, max_words, first, covered):
    """Ranked phrases by listing every occurrence."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, max_words + 1):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    rows = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        told = []
        for p, a in candidates.items():
            score, k = min((2000000 * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(len(q) > len(p) and 100 * b >= covered * a and inside(q) for q, b in candidates.items()):
                told.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(told)[:first], 1):
            rows.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(rows)


def test_collocations_equal_listing_every_occurrence(spark, make, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [". ".join(random_texts(rng, 6)) for _ in range(150)] + ODD_TEXTS + ["New York is big, New\tYork IS big"] * 40
    texts += ["the same old line " * 500, "é\x00ß ü; é\x00ß ü " * 30, "q" * 100_000]
    langs = [["en", "de", None, "und"][i % 4] for i in range(len(texts))]
    docs = make(tmp_path, texts, langs=langs, extra=("phrase", "freq", "rank"))
    for max_words, chunk in ((4, 16), (4, 2), (2, 3), (3, 1)):
        monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
        got = sorted(map(tuple, collocations.collocations(docs, least=12, max_words=max_words, first=40).collect()))
        assert got == phrase_table(list(zip(texts, langs, strict=True)), 12, max_words, 40, 80)


def test_collocations_of_empty_tables_and_small_slices(spark, make, tmp_path, monkeypatch):
    assert collocations.collocations(make(tmp_path, [])).count() == 0
    assert collocations.collocations(make(tmp_path, [None, "", ".;"])).count() == 0
    docs = make(tmp_path, ["a b c, a b"] * 40)
    whole = sorted(map(tuple, collocations.collocations(docs).collect()))
    monkeypatch.setattr(collocations, "SLICE_BYTES", 8)
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == whole
    assert [r[2:4] for r in whole] == [("a b", 80), ("a b c", 40)]


def test_parse_owns_every_word_once_and_shares_equal_passages(spark, make, tmp_path):
    rng = np.random.default_rng(8)
    passage = " ".join(f"w{int(i)}" for i in rng.integers(0, 500, 4000))
    texts = [f"{' '.join(random_texts(rng, 3))} {passage}" for _ in range(20)]
    rows = collocations.parse(make(tmp_path, texts), 4, "lang", "text").collect()
    assert sum(r["owned"] * r["freq"] for r in rows) == sum(len(t.split()) for t in texts)
    # The passage is cut alike in all texts, so the dictionary holds it about once.
    assert sum(r["owned"] for r in rows) < 2 * 4000
    assert all(r["owned"] in (len(r["chunk"].split()), len(r["chunk"].split()) - 3) for r in rows)


def test_bit_filter_holds_all_phrases_and_few_others(spark):
    phrases = [(lang, f"a{i} b{i} c") for i in range(3000) for lang in ("en", "de")]
    made = collocations.BitFilter.of(spark.createDataFrame(phrases, "lang string, phrase string"), 3)
    hashes = lambda lang, words: collocations._phrase_hashes(
        np.repeat(np.array([collocations.xxhash.xxh64_intdigest(lang)], np.uint64), 3 * len(words)),
        collocations.Words(pa.array(words, pa.binary())).hashes, 3,
    )[::3]
    assert made.holds(hashes("de", [p.encode() for _, p in phrases])).all()
    assert made.holds(hashes("fr", [p.encode() for _, p in phrases])).mean() < 0.1


GOOD = "the of and to in that was with river stone window garden morning letter quiet answer walked under bright evening".split()


def labelled_texts(rng, n):
    """Prose, shouting, repetition and symbols in turn; only prose is good."""
    texts, marks = [], []
    for i in range(n):
        prose = " ".join(rng.choice(GOOD, rng.integers(20, 300)))
        kind = i % 6
        bad = {3: prose.upper().replace(" ", "!! "), 4: f"{prose.split()[0]} " * 150, 5: prose.replace(" ", "%%% ")}
        texts.append(bad.get(kind, prose))
        marks.append(int(kind < 3))
    return texts, marks


def test_quality_on_held_out_rows(spark, make, tmp_path):
    texts, marks = labelled_texts(np.random.default_rng(6), 600)
    docs = make(tmp_path, texts)
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, quality int")
    model = quality.learn(docs, labels.where(quality.fold() != 1), label_col="quality")
    rows = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    unseen = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(rows) == 600 and all(0 <= s <= 1 for s in rows.values())
    assert np.mean([(rows[i] >= 0.5) == marks[i] for i in unseen]) > 0.97
    # Scores are probabilities: their mean meets the share of label 1.
    assert abs(np.mean([rows[i] for i in unseen]) - np.mean([marks[i] for i in unseen])) < 0.05


def test_quality_sizes_and_scores_by_hand(spark, make, tmp_path):
    texts, marks = labelled_texts(np.random.default_rng(7), 120)
    texts[0] = "the river " * 500_000
    docs = make(tmp_path, [*texts, *ODD_TEXTS], extra=("label", "score", "block"))
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, label int")
    model = quality.learn(docs, labels)
    rows = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    import zstandard

    for i, text in enumerate([*texts, *ODD_TEXTS]):
        data = (text or "").encode()
        sizes = [0, 0]
        for at in range(0, len(data), 4096):
            for side, learned in enumerate((model.good, model.bad)):
                frame = zstandard.ZstdCompressor(
                    level=3, dict_data=zstandard.ZstdCompressionDict(learned), write_content_size=False, write_dict_id=False
                ).compress(data[at : at + 4096])
                sizes[side] += len(frame)
        n = len(data)
        if not n:
            assert rows[i] == model.share
            continue
        d, r, length = (sizes[1] - sizes[0]) / n, sizes[0] / n, math.log1p(n)
        x = np.array([d, r, length, d * length, r * length, d * d, r * r, length * length])
        x = (x - model.mean) / model.spread
        want = 1 / (1 + math.exp(-min(30, max(-30, model.slopes[0] + x @ model.slopes[1:]))))
        # Precomputed dictionaries may save or cost a byte or two.
        assert rows[i] == pytest.approx(want, abs=0.05), text[:40]


def test_quality_without_labels_of_both_classes(spark, make, tmp_path):
    docs = make(tmp_path, ["a b", None, "c"])
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, label int")
    scores = lambda rows: {r["score"] for r in quality.score(docs, quality.learn(docs, labels(rows))).collect()}
    assert scores([]) == {0.5}
    assert scores([(0, None), (None, 1)]) == {0.5}
    assert scores([(0, 1), (0, 1), (2, 1)]) == {1.0}
    assert scores([(0, 0), (0, 1), (2, 0)]) == {0.0}  # a document with both labels is left out
    none = make(tmp_path, [])
    assert quality.score(none, quality.learn(none, labels([(0, 1)]))).count() == 0


def test_quality_sample_is_bounded_and_uses_no_other_rows(spark, make, tmp_path):
    texts, marks = labelled_texts(np.random.default_rng(9), 200)
    docs = make(tmp_path, texts)
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, label int")
    sample = quality.labelled_sample(docs, labels, "doc_id", "text", 20).collect()
    assert Counter(r["label"] for r in sample) == {0: 20, 1: 20}
    assert all(r["label"] == marks[r["doc_id"]] and bytes(r["text"]).decode() == texts[r["doc_id"]] for r in sample)


@pytest.mark.parametrize("name", ["op11_quality", "op13_lexical_search"])
def test_registered_query_columns(spark, sf_dir, name):
    got = registered.QUERIES[name](spark, sf_dir)
    want = {
        "op11_quality": "doc_id bigint, held_out boolean, score double, predicted int",
        "op13_lexical_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    }[name]
    assert ", ".join(f"{n} {t}" for n, t in got.dtypes) == want
    rows = got.collect()
    if name == "op11_quality":
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
        assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    else:
        docs = [(r["doc_id"], r["text"]) for r in registered.documents(spark, sf_dir).collect()]
        items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
        assert sorted(map(tuple, rows), key=str) == ranking(docs, items)
