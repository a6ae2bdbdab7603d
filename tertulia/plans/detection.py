"""Transcripts to semantic detections and to the validated table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame

from tertulia.config import ChunkOptions, CleanOptions, RuleSet
from tertulia.operators.parsing import clean_call, parse_clean_turns
from tertulia.operators.rules import rules_table
from tertulia.operators.scoring import TASKS, Complete, keep_validated, review
from tertulia.operators.semantic import (
    best_match,
    catalog_phrases,
    chunk_turns,
    detections,
    encode_column,
    split_sentences,
)
from tertulia.sources.answers import AnswerStore
from tertulia.sources.staging import settle
from tertulia.sources.tables import order_columns
from tertulia.sources.transcripts import with_rejects

Encoder = Callable[[], Callable[[np.ndarray], np.ndarray]]


def clean_and_chunk(
    calls: DataFrame,
    clean: CleanOptions,
    chunks: ChunkOptions,
    split: Callable[[Column], Column] = split_sentences,
) -> DataFrame:
    """``archivo, turn_no, speaker_num, chunk_no, chunk``, all within the row of the call."""
    return chunk_turns(parse_clean_turns(clean_call(calls, clean)), chunks, split)


def score(
    chunks: DataFrame,
    rules: RuleSet,
    make_encoder: Encoder,
    make_catalog_encoder: Encoder | None = None,
    batch_size: int = 64,
) -> DataFrame:
    """Every chunk with its best phrase and similarity, or with ``parse_error`` where it could not be encoded.

    Catalog and encoded chunks are settled, so each text is encoded once. Runs jobs.
    """
    phrases = catalog_phrases(rules_table(chunks.sparkSession, rules))
    catalog = settle(encode_column(phrases, "frase", make_catalog_encoder or make_encoder, batch_size))
    return best_match(settle(encode_column(chunks, "chunk", make_encoder, batch_size)), catalog)


def detect(
    chunks: DataFrame, rules: RuleSet, make_encoder: Encoder, threshold: float, batch_size: int = 64
) -> tuple[DataFrame, DataFrame]:
    """Detections, and the chunks that could not be encoded with their errors. Runs jobs."""
    scored = score(chunks, rules, make_encoder, batch_size=batch_size)
    good, rejects = with_rejects(scored)
    names = ("archivo", "turn_no", "chunk_no", "chunk", "parse_error")
    return detections(good, threshold), rejects.select(*(n for n in names if n in rejects.columns))


def validate(
    found: DataFrame,
    complete: Complete,
    template: str,
    keywords: Sequence[str],
    columns: Sequence[str] = (),
    workers: int = 4,
    tasks: int = TASKS,
    store: AnswerStore | None = None,
) -> DataFrame:
    """Detections the reviewer confirms. They are settled first, so encoding is not repeated by the review.

    Runs jobs. At most ``workers * tasks`` prompts are open at a time. With a ``store``, a job that was lost asks only
    what has no answer yet.
    """
    reviewed = review(settle(found), complete, template, keywords, workers, tasks, store)
    return order_columns(keep_validated(reviewed), columns)
