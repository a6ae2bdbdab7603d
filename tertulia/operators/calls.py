"""Talk time, sentiment and duration per call, and the final table of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia.functions.scores import sentiment_score
from tertulia.functions.text import strip
from tertulia.sources.staging import settle

# The two speakers that are measured.
SPEAKERS = {1: "Speaker 1", 2: "Speaker 2"}


def call_metrics(turns: DataFrame, check_labels: bool = False) -> DataFrame:
    """One row per call from timed, labelled turns ``archivo, speaker, start_sec, duration_sec, label``.

    Time and labels of other speakers count for nobody; calls without turns have no row. With
    ``check_labels``, ``parse_error`` marks the calls in which a measured turn has no label.
    """
    said = F.col("speaker")

    def talk_time(name: str) -> Column:
        return F.sum(F.when(said == name, F.col("duration_sec")).otherwise(0)).cast("int")

    def sentiment(name: str) -> Column:
        mean = F.avg(F.when(said == name, sentiment_score(F.col("label"))))
        return F.coalesce(F.round(mean, 3), F.lit(0.0))

    missing = F.count_if(said.isin(*SPEAKERS.values()) & F.col("label").isNull()) > 0
    return turns.groupBy("archivo").agg(
        F.max("start_sec").alias("duracion_total_seg"),
        *[talk_time(name).alias(f"tiempo_speaker{n}_seg") for n, name in SPEAKERS.items()],
        *[sentiment(name).alias(f"sentimiento_speaker{n}") for n, name in SPEAKERS.items()],
        *([F.when(missing, "sentiment failed").alias("parse_error")] if check_labels else []),
    )


def join_detections(calls: DataFrame, found: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Calls left-joined to their detections on ``archivo``; null names match null names.

    A left join cannot split a call with very many detections, an inner one can (adaptive skew join). So
    each call without detections is given one empty row, and the join is inner. ``found`` is read twice, for its
    names and for its rows, so it is settled first. ``names`` is a table that has the names of the calls and is cheap to
    read again; without it the calls themselves are settled. Runs jobs.
    """
    right = settle(found.withColumnRenamed("archivo", "_call"))
    if names is None:
        names = calls = settle(calls)
    same = F.col("archivo").eqNullSafe(F.col("_call"))
    silent = names.select("archivo").distinct().join(right.select("_call").distinct(), same, "left_anti")
    rows = right.unionByName(silent.withColumnRenamed("archivo", "_call"), allowMissingColumns=True)
    return calls.join(rows, same).drop("_call")


def join_summaries(calls: DataFrame, summaries: DataFrame) -> DataFrame:
    """Left join on ``archivo``; several summaries of a call multiply its rows."""
    right = summaries.withColumnRenamed("archivo", "_call")
    same = F.col("archivo").eqNullSafe(F.col("_call"))
    return calls.join(right, same, "left").drop("_call")


def named_calls(calls: DataFrame) -> DataFrame:
    """Call names as the final table has them. Figures that need no detections are read from this table alone."""
    return calls.withColumn("archivo", strip(F.col("archivo")))


def final_calls(metrics: DataFrame, found: DataFrame, summaries: DataFrame) -> DataFrame:
    """Metrics, detections and summary, one row per call and detection.

    Call names are stripped on all three sides. Summaries join first, while there is one row per call, so
    the detections, the largest input, move once. Metrics, one narrow row per call, are settled: their names are
    compared with those of the detections before they are joined. Runs jobs.
    """
    named = found.withColumn("archivo", strip(F.col("archivo_origen")))
    calls = settle(named_calls(metrics))
    told = join_summaries(calls, named_calls(summaries))
    columns = [*calls.columns, *found.columns]
    columns += [name for name in summaries.columns if name != "archivo"]
    return join_detections(told, named, calls).select(*columns)
