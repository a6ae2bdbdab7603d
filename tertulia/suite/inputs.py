"""How the given tables stand for calls, turns, detections and the other inputs of the jobs.

A conversation is a call: the user is the client (speaker 1), the assistant the agent (2), the system a third
speaker. Times grow by seven seconds a turn plus a part that depends on the text, so some run backwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tertulia.config import ChunkOptions, CleanOptions, RuleSet
from tertulia.functions.text import to_clock

#: Turns of up to so many characters are taken as silence where a query needs silent turns.
SILENT = 80
INSTRUCTION = "Resumen breve:"
#: Document numbers of a file that the folder queries write, and the source whose files are no UTF-8.
FILE_DOCS, OTHER_ENCODING = 1000, "src3"
#: Language of the documents that are asked about first where two jobs share their answers.
FIRST_LANG = "de"
PREAMBLE = "{ 0:00 }\nBefore the first speaker.\n\n"

RULES = RuleSet(
    patterns={
        "MOMENT": {"later": ["(than|then)[a-z]* (the|of)", "from th", "on[a-z]+ing"], "busy": ["was (a|in) ", "tion of"]},
        "USE": {"no_need": ["que (la|el|de) ", "no (es|hay)", "[a-z]+ción"], "has_other": ["(est|un) (de|la)", "el[a-z]* a"]},
        "SAFETY": {"risk": ["der (ein|und)", "und d(ie|as|er)"], "doubt": ["é"]},
        "FACTS": {"detail": ["this (is|was|with)", "[0-9]+"], "price": ["est (le|la|en)", "pour ", "(et|de) [a-z]e"]},
    },
    intensity={"later": 2, "busy": 1, "no_need": 3, "risk": 3, "detail": 1, "price": 2},
)
CLEANING = CleanOptions(fillers=("eh", "o sea", "ado"))
CHUNKING = ChunkOptions(min_sentence_length=10, min_words=3, window=3, overlap=1, irrelevant=("of the and",))
TEMPLATE = "Frase: {phrase}\nCategoria {category} / tipo {obj_type}. {{Responde SI o NO}}"
KEYWORDS = ("SI", "SÍ")
THRESHOLD = 0.3
LETTER_THRESHOLD = 0.8
LETTERS = "abcdefghijklmnopqrstuvwxyz"


SCHEMAS = {
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def conversation_turns(spark: SparkSession, folder: str) -> DataFrame:
    seconds = F.col("start_sec")
    return (
        table(spark, folder, "conversations")
        .selectExpr(
            "concat('call_', conv_id) AS archivo",
            "CAST(turn AS int) AS turn_no",
            "CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS speaker_num",
            "CAST(turn * 7 + length(text) % 23 AS int) AS start_sec",
            "text",
        )
        .select(
            "archivo",
            "turn_no",
            F.concat(F.lit("Speaker "), "speaker_num").alias("speaker"),
            "speaker_num",
            to_clock(seconds).alias("timestamp"),
            "start_sec",
            "text",
        )
    )


def conversation_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """``archivo, raw``: the transcript of each call, one text as in a folder of files."""
    block = F.struct("turn_no", F.concat("speaker", F.lit(":  { "), "timestamp", F.lit(" }\n"), "text").alias("block"))
    calls = conversation_turns(spark, folder).groupBy("archivo").agg(F.array_sort(F.collect_list(block)).alias("turns"))
    return calls.select("archivo", F.concat(F.lit(PREAMBLE), F.array_join("turns.block", "\n\n")).alias("raw"))


def sparse_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """The transcripts, where turns of up to ``SILENT`` characters say nothing, and calls of one turn have none."""
    block = F.struct(
        "turn_no",
        F.concat(
            "speaker", F.lit(":  { "), "timestamp", F.lit(" }\n"), F.when(F.length("text") > SILENT, F.col("text")).otherwise("")
        ).alias("block"),
    )
    calls = conversation_turns(spark, folder).groupBy("archivo").agg(F.array_sort(F.collect_list(block)).alias("turns"))
    said = F.when(F.size("turns") > 1, F.array_join("turns.block", "\n\n")).otherwise("")
    return calls.select("archivo", F.concat(F.lit(PREAMBLE), said).alias("raw"))


def special_clients(turns: DataFrame) -> DataFrame:
    """Calls in which a third speaker talks have the client on line 2."""
    return turns.where("speaker_num = 3").select("archivo").distinct().withColumn("client", F.lit(2))


def text_label(text: Column) -> Column:
    """A sentiment label that depends on the text's length only."""
    left = F.length(text) % 4
    return F.when(left == 0, "POS").when(left == 1, "NEG").when(left == 2, "NEU").otherwise("OTHER")


def letter_counts(texts):
    """Stand-in encoder: how often each letter occurs."""
    import numpy as np

    return np.array([[text.count(letter) for letter in LETTERS] for text in texts], dtype=np.float32)


def label_by_length(texts):
    import numpy as np

    names = ("POS", "NEG", "NEU", "OTHER")
    return np.array([names[len(text) % 4] for text in texts])


def answer_by_length(prompt: str) -> str | None:
    """Stand-in reviewer: agrees, refuses, fails or says nothing, by the prompt's length."""
    kind = len(prompt) % 5
    if kind == 3:
        raise RuntimeError("no answer")
    return (" si, es una objeción ", "no", "Sí.", "", None)[kind]


def summary_by_length(prompt: str) -> str | None:
    return None if len(prompt) % 7 == 0 else f" {len(prompt)} caracteres " if len(prompt) % 7 < 6 else " "


def make_encoder():
    return letter_counts


def fussy_letter_counts(texts):
    """Stand-in encoder that fails on texts whose length is a multiple of eleven."""
    if any(len(text) % 11 == 0 for text in texts):
        raise ValueError("unreadable")
    return letter_counts(texts)


def make_fussy_encoder():
    return fussy_letter_counts


def split_at_commas(texts):
    """Stand-in sentence splitter."""
    return [text.replace(";", ",").split(",") for text in texts]


def make_classifier():
    return label_by_length


def label_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """A catalog with one entry per embedding label, its mean vector."""
    place = F.posexplode("embedding").alias("place", "value")
    means = (
        table(spark, folder, "embeddings")
        .select("label", place)
        .groupBy("label", "place")
        .agg(F.avg(F.col("value").cast("double")).alias("value"))
    )
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("all"))
    name = F.concat(F.lit("label "), F.col("label"))
    return vectors.select(
        F.col("label").alias("cat_id"),
        name.alias("frase"),
        F.when(F.col("label") % 2 == 0, "EVEN").otherwise("ODD").alias("categoria"),
        F.concat(F.lit("t"), F.col("label")).alias("tipo"),
        F.transform("all", lambda e: e["value"]).alias("embedding"),
    )


def vector_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("call_"), F.col("label")).alias("archivo"),
        F.col("vec_id").alias("turn_no"),
        F.lit(0).alias("chunk_no"),
        F.concat(F.lit("chunk "), F.col("vec_id")).alias("chunk"),
        "embedding",
    )


def document_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a rule pattern with a boundary mark and two groups around its text."""
    pattern = F.concat(
        F.lit(r"\b(?:"), "lang", F.lit(") "), "text", F.lit(" ("), "source", F.lit(r")?\b")
    )
    return table(spark, folder, "documents").select(
        F.col("source").alias("type"),
        F.col("lang").alias("category"),
        F.lit(0).alias("type_ord"),
        F.lit(0).alias("category_ord"),
        F.col("doc_id").alias("pattern_ord"),
        pattern.alias("pattern"),
    )


def document_detections(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("call_"), F.col("doc_id")).alias("archivo_origen"),
        F.col("text").alias("frase_original"),
        F.col("source").alias("categoria"),
        F.col("lang").alias("tipo"),
    )


def stored_answers(spark: SparkSession, folder: str) -> DataFrame:
    """An answer per labelled document; some are empty of meaning, some null."""
    quality, toxic = F.col("quality"), F.col("toxic")
    answer = (
        F.when((quality == 1) & (toxic == 0), " sí, es objeción ")
        .when((quality == 1) & (toxic == 1), "Posible")
        .when((quality == 0) & (toxic == 0), "no")
    )
    return table(spark, folder, "labels").select("doc_id", answer.alias("answer"))
