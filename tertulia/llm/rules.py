"""Quality rules and a log-likelihood-ratio filter, in DataFrame functions alone.

Hashed n-grams (single tokens and pairs) of all trusted documents and of the whole raw corpus give two multinomials. A document's score is the mean over its n-grams of the logarithm of trusted over raw probability, so
length does not matter, and every document above one threshold is kept: nothing is drawn at random.

Words are what white space separates; tokens of n-grams are runs of letters and digits, or of other visible characters.
A document without tokens has score 0. Null texts have no words. The n-gram table has a fixed size, so counting is one
partial aggregation, and the log ratios reach the tasks as a literal array.

Rows are never merged: repeated rows repeat their results, other columns stay, and columns named like results are
replaced. An empty corpus, or one without trusted documents, gives log ratios of 0: only the rules decide.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia.llm.common import let

BUCKETS = 1 << 14
#: Least mean log ratio of a document that is kept.
THRESHOLD = -0.45
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
SPACE = r"[\x20\x09-\x0D]+"
SHORT_WORDS, WINDOW, REPEATED_PERCENT = 10, 5, 20


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    spoken = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(spoken, lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def _windows(hashes: Column) -> Column:
    """A hash of each window of five words, from the hashes of the words."""
    starts = F.when(F.size(hashes) >= WINDOW, F.sequence(F.lit(0), F.size(hashes) - WINDOW)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more."""
    numbered = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def starts(found: Column) -> Column:
        twice = F.filter(
            found,
            lambda e, k: (F.get(found, k - 1)["h"] == e["h"]) | (F.get(found, k + 1)["h"] == e["h"]),
        )
        return F.array_sort(F.transform(twice, lambda e: e["i"]))

    def total(found: Column) -> Column:
        reach = F.transform(
            found, lambda s, k: F.least(F.coalesce(F.get(found, k + 1), s + WINDOW) - s, F.lit(WINDOW)).cast("long")
        )
        return F.aggregate(reach, F.lit(0).cast("long"), lambda n, r: n + r)

    return let(let(F.array_sort(numbered), starts), total)


def repeated_words(own: Column) -> Column:
    """Words in five-word windows found twice or more in the text, the first included; ``own`` is its words."""

    def of_windows(windows: Column) -> Column:
        distinct = F.size(F.array_distinct(windows))
        return F.when(distinct == F.size(windows), F.lit(0).cast("long")).otherwise(_covered(windows))

    return let(F.transform(own, lambda w: F.xxhash64(w)), lambda hashes: let(_windows(hashes), of_windows))


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the single tokens and the pairs of a text."""

    def both(hashes: Column) -> Column:
        single = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
        pairs = F.transform(
            F.slice(hashes, 2, F.size(hashes)),
            lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(buckets)).cast("int"),
        )
        return F.concat(single, pairs)

    return let(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), lambda t: F.xxhash64(t)), both)


@dataclass(frozen=True)
class LogRatios:
    """Logarithm of trusted over raw probability of each bucket."""

    values: tuple[float, ...]

    def column(self) -> Column:
        """The values as a literal array; the optimiser folds the text into it once."""
        return F.split(F.lit(" ".join(f"{v:.9g}" for v in self.values)), " ").cast("array<double>")

    def score(self, text: Column) -> Column:
        """Mean log ratio over the n-grams of a text."""
        table = self.column()

        def mean(grams: Column) -> Column:
            total = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(table, b))
            return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(0.0)

        return let(ngram_buckets(text, len(self.values)), mean)


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """Ids of all labelled documents of good quality."""
    return labels.groupBy(doc_id).agg(F.avg(label).alias("mean")).filter("mean >= 0.5").select(doc_id)


def fit(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> LogRatios:
    """Counts the n-grams of all documents, and of the trusted ones.

    One plan at all sizes: texts and trusted ids meet in one exchange on the id, and the ids of a partition are hashed.
    """
    ids = trusted.select(F.col(doc_id).alias("id")).distinct().withColumn("trusted", F.lit(1))
    marked = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = marked.join(ids.hint("shuffle_hash"), "id", "left")
    grams = marked.select("trusted", F.explode(ngram_buckets(F.col("text"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("trusted")).collect()
    raw, good = [0] * buckets, [0] * buckets
    for row in counts:
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["trusted"]
    if not any(good):
        return LogRatios((0.0,) * buckets)
    scale = math.log((sum(raw) + buckets) / (sum(good) + buckets))
    return LogRatios(tuple(math.log((g + 1) / (r + 1)) + scale for g, r in zip(good, raw, strict=True)))


def with_rules(docs: DataFrame, ratios: LogRatios, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the counts of the rules, ``base_failed``, ``log_ratio`` and ``kept``."""
    body = F.coalesce(F.col(text), F.lit(""))
    counted = let(
        words(body),
        lambda own: F.struct(
            F.size(own).cast("long").alias("n_words"),
            F.char_length(F.array_join(own, "")).cast("long").alias("word_chars"),
            repeated_words(own).alias("n_repeat_words"),
        ),
    )
    symbols = F.char_length(body) - F.char_length(F.regexp_replace(body, r"[#*$%&|<>]+", ""))
    out = docs.withColumns(
        {
            "rule__": counted,
            "n_symbols": symbols.cast("long"),
            "n_dup_lines": duplicate_lines(body).cast("long"),
            "log_ratio": ratios.score(body),
        }
    )
    out = out.withColumns({n: F.col("rule__")[n] for n in ("n_words", "word_chars", "n_repeat_words")}).drop("rule__")
    failed = (F.col("n_words") < SHORT_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold)
    )
