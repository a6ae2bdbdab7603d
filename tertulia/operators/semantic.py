"""Chunks of speech matched against a catalog of objection phrases by cosine similarity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia.config import ChunkOptions
from tertulia.functions import text as T
from tertulia.operators.scoring import once, run_model
from tertulia.operators.turns import number_rows, number_sorted
from tertulia.sources.staging import settle

SENTENCE_END = r"[\n.!?]+"
# Bytes of the catalog vectors that are sent to the workers at a time, and slices compared before the best so far
# is settled. Neither changes a result.
SLICE_BYTES = 64 << 20
SLICES_PER_PASS = 8
# Similarities equal to so many digits are equal; the first entry wins.
DIGITS = 12
# Size of one similarity matrix in a worker.
SIMILARITY_CELLS = 4_000_000

CATALOG = ("cat_id", "frase", "categoria", "tipo")


def catalog_phrases(rules: DataFrame) -> DataFrame:
    """``cat_id, frase, categoria, tipo`` of a rules table, in rule order, without empty phrases. Runs a job.

    The outer rule level is the catalog's ``categoria`` and the inner one its ``tipo``.
    """
    place = F.struct("type_ord", "category_ord", "pattern_ord")
    phrases = rules.select("type", "category", place.alias("_place"), T.regex_to_phrase(F.col("pattern")).alias("frase"))
    phrases = settle(phrases.where("frase <> ''"))
    return number_sorted(phrases, "_place", "cat_id").select(
        "cat_id", "frase", F.col("type").alias("categoria"), F.col("category").alias("tipo")
    )


def split_sentences(text: Column, pattern: str = SENTENCE_END) -> Column:
    return F.split(text, pattern, -1)


def split_with(split: Callable[[list[str]], list[list[str]]]) -> Callable[[Column], Column]:
    """Sentence arrays from a caller's splitter, which gets the texts of an Arrow batch."""

    @F.pandas_udf("array<string>")
    def sentences(texts: pd.Series) -> pd.Series:
        return pd.Series(split(texts.fillna("").tolist()), dtype=object)

    return sentences


def chunk_turns(
    turns: DataFrame,
    options: ChunkOptions,
    split: Callable[[Column], Column] = split_sentences,
    column: str = "texto",
) -> DataFrame:
    """One row per relevant window of sentences: the turn's columns, ``chunk_no`` and ``chunk``."""
    rest = [name for name in turns.columns if name != column]
    trimmed = F.transform(F.col("_parts"), T.strip)
    long_enough = F.filter(trimmed, lambda s: F.length(s) > options.min_sentence_length)
    windows = T.sliding_windows(F.col("_sentences"), options.window, options.overlap)
    relevant = F.filter(
        windows, lambda c: T.is_relevant(c, options.min_words, options.irrelevant)
    )
    return (
        turns.select(*rest, split(F.col(column)).alias("_parts"))
        .select(*rest, long_enough.alias("_sentences"))
        .select(*rest, relevant.alias("_chunks"))
        .select(*rest, F.posexplode_outer("_chunks").alias("chunk_no", "chunk"))
        .where(F.col("chunk_no").isNotNull())
    )


def encode_column(
    df: DataFrame,
    column: str,
    make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]],
    batch_size: int = 64,
) -> DataFrame:
    """Add ``embedding`` from a caller's model, loaded once per task and fed in batches, and ``parse_error``.

    A text the model fails on has a null embedding and the error; ``with_rejects`` takes such rows out.
    """
    encode = run_model(make_encoder, "array<float>", batch_size)
    return (
        df.withColumn("_model", encode(F.col(column)))
        .withColumns({"embedding": F.col("_model.value"), "parse_error": F.col("_model.error")})
        .drop("_model")
    )


def vectors_of(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


def cosines(rows: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Cosine of each row to each row of ``base``; 0 where one has no length.

    The products are divided last and by one root, so that vectors of whole numbers lose nothing before.
    """
    lengths = np.sqrt(np.outer(_squares(rows), _squares(base)))
    return np.divide(rows @ base.T, lengths, out=np.zeros_like(lengths), where=lengths > 0)


def _best(rows: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest cosine of each row, as rounded, to the rows of ``base``, and the first of those that reaches it."""
    slices = max(1, len(rows) * len(base) // SIMILARITY_CELLS)
    tops, firsts = [], []
    for part in np.array_split(rows, slices):
        near = cosines(part, base)
        first = near.round(DIGITS).argmax(axis=1)
        tops.append(near[np.arange(len(part)), first])
        firsts.append(first)
    return np.concatenate(tops), np.concatenate(firsts)


def best_match(chunks: DataFrame, catalog: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Every chunk with ``cat_id, similarity`` and its phrase's columns; null where it has no embedding.

    The best entry has the highest similarity, rounded to ``DIGITS``, and of equal ones the lowest ``cat_id``. The
    catalog is sent to the workers in slices of at most ``slice_bytes`` of vectors, and each chunk keeps its best so
    far, so chunks are scored where they lie. Its phrases are joined afterwards, broadcast if their bytes fit a slice.
    With several slices the encoded chunks are settled first: jobs run when
    this is called, and no chunk is encoded twice. A catalog phrase that could not be encoded is an error.
    """
    base = catalog.select(*CATALOG, "embedding")
    texts = sum((F.coalesce(F.octet_length(n), F.lit(0)) for n in CATALOG[1:]), F.lit(16))
    count, width, missing, text_bytes = base.agg(
        F.count("embedding"), F.max(F.size("embedding")), F.count_if(F.col("embedding").isNull()), F.sum(texts)
    ).first()
    if missing:
        raise ValueError(f"{missing} catalog phrases have no embedding")
    if not count:
        return chunks.select(
            "*",
            *(F.lit(None).cast(kind).alias(name) for name, kind in _MATCH_COLUMNS.items()),
        )
    rows = max(1, slice_bytes // (8 * width))
    slices = -(-count // rows)
    if slices > 1:
        chunks = settle(chunks)
        base = settle(number_rows(base, "cat_id", name="_row"))
    best = F.lit(None).cast(_BEST)
    for i in range(slices):
        part = base if slices == 1 else base.where(F.col("_row").between(i * rows, (i + 1) * rows - 1))
        part = part.select("cat_id", "embedding").toArrow().sort_by("cat_id")  # bounded by slice_bytes
        best = F.greatest(best, _nearest(chunks, part)("embedding")) if i else _nearest(chunks, part)("embedding")
        if i % SLICES_PER_PASS == SLICES_PER_PASS - 1 and i < slices - 1:
            chunks = settle(chunks.withColumn("_best", best))
            best = F.col("_best")
    found = chunks.withColumn("_near", best).select(
        *[c for c in chunks.columns if c != "_best"],
        (-F.col("_near.rank")).alias("cat_id"),
        F.col("_near.similarity").alias("similarity"),
    )
    phrases = catalog.select(*CATALOG)
    return found.join(F.broadcast(phrases) if text_bytes <= slice_bytes else phrases, "cat_id", "left")


#: Compared field by field: the rounded similarity, then the lower number.
_BEST = "struct<level:double,rank:int,similarity:double>"
_MATCH_COLUMNS = {
    "cat_id": "int", "similarity": "double", "frase": "string", "categoria": "string", "tipo": "string"
}


def _nearest(chunks: DataFrame, part: pa.Table):
    """Best entry of one slice for a batch of vectors; null for a null vector."""
    ids = part["cat_id"].to_numpy().astype(np.int32)
    shared = chunks.sparkSession.sparkContext.broadcast((ids, vectors_of(part["embedding"])))

    @F.arrow_udf(_BEST)
    def nearest(vectors: pa.Array) -> pa.Array:
        ids, base = shared.value
        given = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        place = np.full(len(vectors), -1)
        place[given] = np.arange(len(given))
        top, first = _best(vectors_of(vectors.drop_null()), base) if len(given) else (np.empty(0), np.empty(0, int))
        found = pa.StructArray.from_arrays(
            [pa.array(top.round(DIGITS)), pa.array(-ids[first], pa.int32()), pa.array(top)],
            names=["level", "rank", "similarity"],
        )
        return found.take(pa.array(place, pa.int64(), mask=place < 0))

    return once(nearest)


def detections(scored: DataFrame, threshold: float) -> DataFrame:
    """Chunks whose unrounded similarity reaches the threshold, in the detection columns.

    ``turn_no`` and ``chunk_no`` are kept when present, to order by and to join on.
    """
    places = [name for name in ("turn_no", "chunk_no") if name in scored.columns]
    return scored.where(F.col("similarity") >= threshold).select(
        F.col("archivo").alias("archivo_origen"),
        F.col("chunk").alias("frase_original"),
        F.col("frase").alias("patron_mas_cercano"),
        "categoria",
        "tipo",
        F.round("similarity", 3).alias("similitud"),
        *places,
    )


def ordered(found: DataFrame) -> DataFrame:
    """Detections sorted by call name and place in the call. Only for output that must be read in order."""
    places = [name for name in ("turn_no", "chunk_no") if name in found.columns]
    return found.orderBy("archivo_origen", *places)


def union_detections(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Detections of several folders, duplicates kept."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def run_counts(scored: DataFrame, threshold: float) -> DataFrame:
    """Chunks processed, detected and discarded per call, counted from the scored rows; a chunk that could not be
    encoded is discarded, and counted as ``failed``."""
    detected = F.count_if(F.col("similarity") >= threshold)
    return (
        scored.groupBy("archivo")
        .agg(
            F.count(F.lit(1)).alias("chunks"),
            detected.alias("detected"),
            F.count_if(F.col("similarity").isNull()).alias("failed"),
        )
        .withColumn("discarded", F.col("chunks") - F.col("detected"))
    )
