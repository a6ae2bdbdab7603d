"""From raw documents to token ids: five stages, each a table that the next one reads.

Every stage works on all rows that the one before it kept. The first four return the columns of ``documents``; the
last returns ids. ``run`` applies them in order and keeps each stage's table on the folder that all executors share.

In every stage: columns other than those of ``documents`` are left out first, so their names clash with nothing; texts are
read whole however long they are; a null ``doc_id`` is a row like others; an empty table gives an empty one. What nulls,
empty texts, ties and repeated rows give is said with each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tertulia.llm import bpe, decontaminate, near_dup, quality, secrets
from tertulia.llm.common import table
from tertulia.llm.suite import bpe_digest
from tertulia.sources.staging import fresh_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What takes the place of a secret.
SECRET = "[SECRET]"
#: Percent of similarity from which two documents are near duplicates.
NEAR = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among them.

    A null text scores as an empty one. Scores at the limit are accepted. Repeated rows share one score and all stay or
    all go. Several labels of a document count by their mean, null ones not at all; without labels nothing is rejected.
    """
    own = docs.select(*COLUMNS)
    model = quality.train(own, table(spark, sf_dir, "labels"))
    scored = quality.with_score(own, model)
    return scored.filter(quality.predicted(F.col("score"), model) == 1).select(*COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least ``doc_id``.

    Null and empty texts are like nothing and stay. Documents at exactly ``NEAR`` percent are linked. Rows that repeat an
    id and a text become one; rows without an id link with nothing.
    """
    return near_dup.deduplicated(docs.select(*COLUMNS), linked=NEAR)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not contain benchmark items: fewer than one word of twenty lies in an item's window.

    Null and empty texts contain nothing and stay, repeated rows as often as they come. Items without an id or without
    words are not looked for; repeated ones count once; an empty benchmark removes nothing.
    """
    hits = decontaminate.with_hits(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return hits.filter(~decontaminate.is_contaminated(F.col("hits"))).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``SECRET`` in place of every secret; ``n_chars`` follows the text.

    A null text stays null and an empty one empty, with their ``n_chars``. Secrets that overlap or touch become one mark.
    Repeated rows are changed alike.
    """
    found = secrets.with_secret_spans(docs.select(*COLUMNS))
    clean = secrets.with_redacted(found, mark=SECRET)
    changed = F.size("secret_spans") > 0
    length = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids and their digests); the digest of the decoded ids shows that nothing was lost.

    A null text has no ids, like an empty one. Of merges with equal ranks the first in the text is done first. One row for
    each row given, repeated ones too.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = bpe.with_decoded(bpe.with_ids(docs.select("doc_id", "text"), path).select("doc_id", "ids"), path)
    return done.select("doc_id", "ids", *bpe_digest())


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_distinct),
    ("benchmark decontamination", keep_clean),
    ("secret scans", redact_secrets),
    ("byte-level BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = fresh_folder(spark, "-".join(name.lower().split()))
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs


#: The stages are models, sketches and token merges, which SQL cannot express.
ORACLE_SQL = None
