"""Sentiment labels, reviews and summaries from callables the user supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tertulia.functions.prompts import objection_prompt, summary_prompt
from tertulia.functions.scores import answer_text, verdict
from tertulia.sources.answers import SCHEMA, AnswerStore
from tertulia.sources.staging import settle

Complete = Callable[[str], str | None]
#: Tasks that ask questions, unless the caller says otherwise, and the questions of a task whose answers are stored.
TASKS, TASK_PROMPTS = 64, 500


def once(function):
    """Keep the optimiser from copying a model call, as it does when a filter on its result moves below it."""
    return function.asNondeterministic()


def run_model(make_model: Callable[[], Callable[[np.ndarray], Sequence]], value_type: str, batch_size: int):
    """A function of a text column to (value, error) by a caller's model, loaded once per task.

    A batch the model fails on is done text by text, and the texts at fault have the error's message. Null texts are
    given as empty ones.
    """

    @F.pandas_udf(f"struct<value:{value_type},error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make_model()

        def one(text: str) -> tuple:
            try:
                return model(np.array([text], dtype=object))[0], None
            except Exception as problem:
                return None, f"{type(problem).__name__}: {problem}"

        def some(texts: np.ndarray) -> list[tuple]:
            try:
                return [(value, None) for value in model(texts)]
            except Exception:
                return [one(text) for text in texts]

        for batch in batches:
            texts = batch.fillna("").to_numpy(dtype=object)
            rows = [row for at in range(0, len(texts), batch_size) for row in some(texts[at : at + batch_size])]
            yield pd.DataFrame(
                {"value": pd.Series([v for v, _ in rows], dtype=object), "error": pd.Series([e for _, e in rows], dtype=object)}
            )

    return once(run)


def label_sentiment(
    turns: DataFrame,
    make_classifier: Callable[[], Callable[[np.ndarray], np.ndarray]],
    column: str = "speech",
    batch_size: int = 8,
) -> DataFrame:
    """Add ``label`` from a caller's classifier, loaded once per task; null where it fails."""
    classify = run_model(make_classifier, "string", batch_size)
    return turns.withColumn("_model", classify(F.col(column))).withColumn("label", F.col("_model.value")).drop("_model")


def _asking(complete: Complete, workers: int, keys: list[str]):
    """Batch function that answers the ``prompt`` column with at most ``workers`` calls at a time."""

    def ask(prompt: str) -> tuple[str | None, str | None]:
        try:
            answer = complete(prompt)
            return (None if answer is None else answer.strip()), None
        except Exception as problem:
            return None, f"{type(problem).__name__}: {problem}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                answers = list(pool.map(ask, batch["prompt"]))
                yield batch[keys].assign(answer=[a for a, _ in answers], error=[e for _, e in answers])

    return run


def answer_prompts(
    asked: DataFrame, complete: Complete, workers: int = 4, tasks: int = TASKS, store: AnswerStore | None = None
) -> DataFrame:
    """``prompt_key, answer, error`` for each different ``prompt``, asked once. Runs a job.

    The prompts are dealt over ``tasks`` tasks, however small they are, so at most ``tasks * workers`` questions are
    open at a time. A failing call gives an error, not a lost batch. The result is settled on reliable storage:
    using it twice, or losing an executor later, does not ask again.

    With a ``store``, prompts it has answers to are not asked, each task's answers are in it when the task ends, and
    the result has a column ``run``. Tasks then have at most about ``TASK_PROMPTS`` questions, so that a lost job loses
    little; there may be more than ``tasks`` of them, and the cores of the cluster bound the questions that are open.
    """
    prompts = asked.select("prompt_key", "prompt").where("prompt is not null").distinct()
    run = _asking(complete, workers, ["prompt_key"])
    if store is None:
        return settle(prompts.repartition(tasks, "prompt_key").mapInPandas(run, SCHEMA))
    prompts = settle(store.unanswered(prompts))
    count = prompts.count()
    if count:
        dealt = prompts.repartition(max(min(tasks, count), -(-count // TASK_PROMPTS)), "prompt_key")
        store.add(dealt.mapInPandas(run, SCHEMA))
    return settle(store.answers_to(asked.where("prompt is not null")))


def apply_answers(
    found: DataFrame, answers: DataFrame, keywords: Sequence[str], on: Sequence[str]
) -> DataFrame:
    """All detections with ``respuesta_llm, validado_llm``, both null where no answer came."""
    joined = found.join(answers, list(on), "left")
    return joined.withColumns(
        {
            "respuesta_llm": answer_text(F.col("answer")),
            "validado_llm": verdict(answer_text(F.col("answer")), keywords),
        }
    ).drop("answer", "error")


def keep_validated(reviewed: DataFrame) -> DataFrame:
    return reviewed.where(F.coalesce(F.col("validado_llm"), F.lit(False)))


def review(
    found: DataFrame,
    complete: Complete,
    template: str,
    keywords: Sequence[str],
    workers: int = 4,
    tasks: int = TASKS,
    store: AnswerStore | None = None,
) -> DataFrame:
    """Detections with the verdict on each; ``keep_validated`` leaves the confirmed ones."""
    prompt = objection_prompt(template, found.columns)
    asked = found.withColumn("prompt", prompt).withColumn("prompt_key", F.sha2("prompt", 256))
    answers = answer_prompts(asked, complete, workers, tasks, store).select("prompt_key", "answer", "error")
    return apply_answers(asked, answers, keywords, ["prompt_key"]).drop("prompt", "prompt_key")


def review_counts(reviewed: DataFrame) -> DataFrame:
    """Detections reviewed and confirmed, in one row."""
    return reviewed.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("validado_llm")).alias("validated")
    )


def summarise(
    calls: DataFrame,
    complete: Complete,
    instruction: str,
    workers: int = 4,
    tasks: int = TASKS,
    store: AnswerStore | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Summaries ``archivo, resumen`` that are not empty, and the calls without one: ``archivo, error``. Runs a job.

    The calls are dealt over ``tasks`` tasks, which bounds the questions that are open; only names and answers are
    written. With a ``store``, calls of equal texts share a question, as in ``answer_prompts``.
    """
    asked = calls.select("archivo", summary_prompt(F.col("raw"), instruction).alias("prompt"))
    if store is None:
        run = _asking(complete, workers, ["archivo"])
        answers = settle(asked.repartition(tasks).mapInPandas(run, "archivo string, answer string, error string"))
    else:
        asked = asked.withColumn("prompt_key", F.sha2("prompt", 256))
        given = answer_prompts(asked, complete, workers, tasks, store)
        answers = settle(asked.drop("prompt").join(given, "prompt_key", "left"))
    told = answers.select("archivo", F.col("answer").alias("resumen"))
    silent = answers.where(F.coalesce(F.length("answer"), F.lit(0)) == 0).select("archivo", "error")
    return drop_empty_summaries(told), silent


def drop_empty_summaries(summaries: DataFrame) -> DataFrame:
    return summaries.where(F.length("resumen") > 0)
