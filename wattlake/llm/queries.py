"""Registered queries of the corpus operators: thin wrappers that derive the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlake.llm import (
    bpe, collocations, exact_dedup, fingerprints, language_id, lexical_search, license_scan, packing, quality, sharding, simhash,
    token_counts, warc,
)
from wattlake.llm.common import documents, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _license_sql() -> str:
    """Every unit against every template, without bounds, and every window that begins with a bigram of the template."""
    quoted = lambda grams: ", ".join(f"'{g}'" for g in grams)
    table = license_scan.templates()
    values = ", ".join(f"('{key}', [{quoted(grams)}])" for key, grams in license_scan.bigram_sets(table))
    sized = ", ".join(
        f"({i}, '{key}', [{quoted(grams)}], {words})"
        for i, (key, grams, words, _) in enumerate(license_scan.window_templates(table, license_scan.THRESHOLD))
    )
    return f"""
    WITH templates(license, grams) AS (VALUES {values}),
    sized(t, license, grams, words) AS (VALUES {sized}),
    units AS (
        SELECT doc_id, 0 AS unit, text AS part FROM documents
        UNION ALL SELECT doc_id, unit::INT, lines[unit]
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS unit FROM documents)),
    words AS (SELECT doc_id, unit, regexp_extract_all(lower(part), '[a-z0-9]+') AS w FROM units),
    runs AS (SELECT doc_id, unit, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] AS run FROM words WHERE len(w) > 1),
    bigrams AS (SELECT doc_id, unit, list_distinct(run) AS grams FROM runs),
    near AS (SELECT * FROM bigrams WHERE list_has_any(grams, (SELECT flatten(list(grams)) FROM templates))),
    of_units AS (
        SELECT doc_id, unit, license, dice, NULL::INT AS word FROM (
            SELECT n.doc_id, n.unit, t.license,
                   2.0::DOUBLE * len(list_intersect(n.grams, t.grams)) / (len(n.grams) + len(t.grams)) AS dice
            FROM near n CROSS JOIN templates t)
        WHERE dice >= 0.8
        QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) = 1),
    places AS (
        SELECT r.doc_id, t.t, r.p FROM (SELECT doc_id, unnest(run) AS gram, unnest(range(1, len(run) + 1)) AS p FROM runs WHERE unit = 0) r
        JOIN (SELECT t, unnest(grams) AS gram FROM sized) t ON r.gram = t.gram),
    -- A window at 0.8 holds two thirds of the template's bigrams, and so does its text.
    likely AS (SELECT doc_id, t FROM places JOIN sized USING (t) GROUP BY doc_id, t HAVING count(*) * 3 >= 2 * any_value(len(grams))),
    scored AS (
        SELECT doc_id, t, license, words, p, 2.0::DOUBLE * len(list_intersect(cut, grams)) / (len(list_distinct(cut)) + len(grams)) AS dice
        FROM (SELECT p.doc_id, p.t, p.p, s.license, s.words, s.grams, list_slice(r.run, p.p, p.p + s.words - 2) AS cut
              FROM places p JOIN likely USING (doc_id, t) JOIN sized s USING (t) JOIN runs r ON r.doc_id = p.doc_id AND r.unit = 0)),
    best AS (SELECT * FROM scored WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, t ORDER BY dice DESC, p) = 1),
    windows AS (SELECT DISTINCT doc_id, license, words, p, dice FROM best)
    SELECT * FROM of_units
    UNION ALL SELECT doc_id, -1, license, dice, p::INT FROM windows x
    WHERE NOT EXISTS (
        SELECT 1 FROM windows y WHERE y.doc_id = x.doc_id AND y.p < x.p + x.words AND x.p < y.p + y.words
        AND (-y.dice, -y.words, y.license, y.p) < (-x.dice, -x.words, x.license, x.p))"""


@query("op1_license_scan", _license_sql())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), n_shards=24)
    return placed.select(
        "doc_id",
        (F.octet_length(text_of()) + 8).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.with_counts(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op4_bpe_round_trip")
def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query(
    "op5_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.outcomes(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint_edits(documents(spark, sf_dir))
    fp, edited, following = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    return found.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(fp).alias("fingerprint"),
        fingerprints.as_text(edited).alias("edited_fingerprint"),
        fingerprints.likeness(fp, edited).alias("near_edited"),
        fingerprints.likeness(fp, following).alias("near_next"),
    )


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), capacity=2048)


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), words_per_shingle=3, radius=2)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.learn(docs.where(language_id.fold() != 0))
    told = language_id.predict(docs, model)
    return docs.select("doc_id", (language_id.fold() == 0).alias("held_out"), told.alias("told")).select(
        "doc_id", "held_out", F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score")
    )


#: SHA-1 in bare base32: 5 hex digits are 4 letters.
BASE32 = """
    SELECT page_id, html, list_aggregate([
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::INT >> (15 - 5 * (k % 4))) & 31), 1)
        for k in range(32)], 'string_agg', '') AS payload_digest
    FROM (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages)"""


@query(
    "op10_warc",
    f"""
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM ({BASE32}))""",
)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")
    records = warc.read_archives(manifest, payloads=False)
    page_id = lambda c: F.regexp_extract(c, r"^<urn:x-page:(.*)>$", 1).cast("long")
    return records.select(
        page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_id("refers_to").alias("refers_to"),
    )


@query("op11_quality")
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality.fold() != 1)
    model = quality.learn(docs, labels, label_col="quality")
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(quality.fold() == 1, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query(
    "op12_collocations",
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, doc_id,
               unnest(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
    phrases AS MATERIALIZED (
        SELECT lang, k, phrase, count(*) AS f
        FROM (SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase
              FROM words CROSS JOIN (VALUES (1), (2), (3), (4)) AS lengths(k) WHERE len(w) >= k)
        GROUP BY ALL HAVING count(*) >= 30),
    candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM phrases WHERE k > 1),
    parts AS MATERIALIZED (
        SELECT lang, phrase, a, cut, array_to_string(w[: cut], ' ') AS first_part, array_to_string(w[cut + 1 :], ' ') AS last_part
        FROM (SELECT lang, phrase, f AS a, w, unnest(range(1, k)) AS cut FROM candidates)),
    cuts AS (
        SELECT p.lang, p.phrase, p.a, p.cut AS k, l.f AS l, r.f AS r, (2000000 * p.a::HUGEINT) // (l.f + r.f) AS score
        FROM parts p
        JOIN phrases l ON l.lang = p.lang AND l.phrase = p.first_part
        JOIN phrases r ON r.lang = p.lang AND r.phrase = p.last_part),
    told AS MATERIALIZED (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    held AS (
        SELECT lang, phrase, max(f) AS longer
        FROM (SELECT lang, f, unnest([array_to_string(w[i : i + m - 1], ' ') for i in range(1, k - m + 2)]) AS phrase
              FROM candidates JOIN (VALUES (2), (3)) AS inner_words(m) ON m < k)
        GROUP BY ALL),
    kept AS (
        SELECT t.* FROM told t LEFT JOIN held h ON h.lang = t.lang AND h.phrase = t.phrase
        WHERE h.longer IS NULL OR 100 * h.longer < 80 * t.a)
    SELECT lang, rank::INT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang)
    WHERE rank <= 2000""",
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), least=30, max_words=4, first=2000)


@query(
    "op13_lexical_search",
    r"""
    WITH terms AS (
        SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM documents),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
    sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY ALL),
    totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM sizes),
    marks AS (SELECT doc_id, 25 + (75 * n * docs) // l AS m FROM sizes CROSS JOIN totals),
    queries AS (
        SELECT item_id, term, count(*) AS repeats
        FROM (SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
        GROUP BY ALL),
    weights AS (
        SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
        FROM (SELECT term, count(*) AS df FROM counts GROUP BY ALL) CROSS JOIN totals),
    scores AS (
        SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
        FROM queries JOIN weights USING (term) JOIN counts USING (term) JOIN marks USING (doc_id) GROUP BY ALL)
    SELECT item_id, rank::INT AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
    WHERE rank <= 10""",
)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical_search.search(docs, items, top=10)
