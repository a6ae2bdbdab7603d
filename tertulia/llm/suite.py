"""Queries of the training-data operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tertulia.llm import (
    bpe,
    chat,
    decontaminate,
    divergence,
    hnsw,
    near_dup,
    personal,
    quality,
    rules,
    secrets,
    shards,
    spelling,
    token_counts,
)
from tertulia.llm.common import sha256, spans_text, table, text_or_empty

#: Texts with more tokens are over the limit.
TOKEN_LIMIT = 512


def token_count(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.with_prefix_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    n_tokens = token_counts.total_tokens(F.col("prefix_tokens"))
    return counted.select(
        "doc_id",
        F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
        n_tokens.alias("n_tokens"),
        (n_tokens > TOKEN_LIMIT).alias("over_limit"),
    )


def find_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    spans = F.col("secret_spans")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secrets.with_secret_spans(docs).select(
        "doc_id",
        *map(count, secrets.BASE_KINDS),
        sha256(spans_text(secrets.base_only(spans))).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )


def find_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    hits = F.col("hits")
    return decontaminate.with_hits(docs, table(spark, folder, "benchmark")).select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        decontaminate.n_hit(hits).alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        sha256(F.array_join(hits["items"], ",")).alias("items_sha256"),
        decontaminate.is_contaminated(hits).alias("contaminated"),
    )


def encode_decode(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = bpe.with_decoded(bpe.with_ids(docs, path).select("doc_id", "ids"), path)
    return done.select("doc_id", *bpe_digest())


def bpe_digest() -> list:
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    ]


def balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard(table(spark, folder, "documents"), 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    log = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    done = chat.render(chat.final_messages(chat.message_events(log)))
    read = done.select(
        "conv_id",
        "formatted",
        chat.read_back(F.col("formatted")).alias("turns"),
        F.array_join(chat.masked_texts(F.col("formatted"), F.col("loss")), "").alias("learnt"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256(F.array_join(lines, "")).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        sha256(F.col("learnt")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


CHAT_SQL = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### : </turn>') + 1
           + 2 * length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', ''))
           + 2 * length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')))::BIGINT
           AS formatted_chars
FROM said GROUP BY conv_id
"""


def classify_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.with_score(docs, model).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        quality.predicted(F.col("score"), model).alias("predicted"),
    )


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ratios = rules.fit(docs, rules.trusted_ids(table(spark, folder, "labels")))
    return rules.with_rules(docs, ratios).drop("text")


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def find_personal(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.personal_spans(table(spark, folder, "documents").select("doc_id", "text"))
    spans = F.col("spans")

    def count(kind: str):
        own = F.filter(spans, lambda s: (s["kind"] == kind) & s["base"])
        return F.size(own).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, personal.BASE_KINDS),
        sha256(spans_text(F.filter(spans, lambda s: s["base"]))).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )


def audit_sources(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
AUDIT_SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}') AS text
    FROM documents
), words AS (
    SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), sizes AS (
    SELECT d.lang, count(k.term) AS v
    FROM (SELECT DISTINCT lang FROM docs) d LEFT JOIN kept k ON k.lang = d.lang GROUP BY d.lang
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), totals AS (
    SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS total, any_value(s.v) AS v
    FROM (SELECT DISTINCT lang, source FROM docs) g JOIN sizes s ON s.lang = g.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), cells AS (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.total + 2 * t.v) AS p
    FROM totals t JOIN kept k ON k.lang = t.lang
    LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), whole AS (
    SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.n) + 2)) // (any_value(t.total) + 2 * any_value(t.v)) AS q
    FROM counts c JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM totals GROUP BY lang) t ON t.lang = c.lang
    GROUP BY c.lang, c.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT c.lang, c.source, 'term', c.term, (c.p - w.q) * (c.p - w.q) // (c.p + w.q)
    FROM cells c JOIN whole w ON w.lang = c.lang AND w.term = c.term WHERE c.n > 0 AND c.p > w.q
)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""


def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, folder, "documents")))


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.nearest(table(spark, folder, "embeddings"), "vec_id % 20 = 0")


CONTAMINATION_SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), items AS (
    SELECT item_id::VARCHAR AS item,
           regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), wanted AS (
    SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS words
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), windows AS (
    SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS words
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM docs CROSS JOIN (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n)
), hits AS (
    SELECT r, i, n, item FROM windows JOIN wanted USING (n, words)
), hit AS (
    SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM hits) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

NEAR_DUPLICATE_SQL = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
    WHERE 100 * shared.n >= 85 * (s.n + t.n - shared.n)
), reach AS (
    SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (
    SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(l.b, d.doc_id) AS kept
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""


QUERIES = {
    "op1_token_counts": token_count,
    "op2_kd_shards": balanced_shards,
    "op3_chat_formatting": chat_formatting,
    "op4_quality_classifier": classify_quality,
    "op5_secret_scans": find_secrets,
    "op6_benchmark_decontamination": find_benchmark,
    "op7_byte_bpe": encode_decode,
    "op8_quality_rules": quality_rules,
    "op10_personal_data": find_personal,
    "op9_minhash_near_dedup": near_duplicates,
    "op11_source_divergence": audit_sources,
    "op12_spelling_variants": spelling_variants,
    "op13_nearest_vectors": nearest_vectors,
}

ORACLES: dict[str, str] = {
    "op3_chat_formatting": CHAT_SQL,
    "op6_benchmark_decontamination": CONTAMINATION_SQL,
    "op9_minhash_near_dedup": NEAR_DUPLICATE_SQL,
    "op11_source_divergence": AUDIT_SQL,
}
