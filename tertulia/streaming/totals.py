"""Corpus figures of a folder that grows, kept up to date instead of counted anew.

A total is a small table of sums and minima by keys. Each batch of new calls gives its own partial table, which is
merged with the table of the batch before and written under the batch's number. A repeated batch merges with the same
table again, so it changes nothing; how calls are dealt to batches changes nothing either, because sums are of whole
numbers and decimals. The work of a batch follows the batch and the number of keys, not the folder.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tertulia.config import ReportOptions, RuleSet
from tertulia.operators import dashboard, reports, semantic
from tertulia.plans.objections import analyse_calls
from tertulia.sources.staging import settle


@dataclass(frozen=True)
class Total:
    """What ``count`` makes of the calls of a batch, merged by ``keys``; columns in ``least`` keep their minimum and all
    others are summed. ``finish`` makes the figures of the merged table."""

    count: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...] = ()
    least: tuple[str, ...] = ()

    def merged(self, parts: DataFrame) -> DataFrame:
        own = [
            (F.min(name) if name in self.least else F.sum(name).cast(kind)).alias(name)
            for name, kind in parts.dtypes
            if name not in self.keys
        ]
        return parts.groupBy(*self.keys).agg(*own)


def corpus(rules: RuleSet, options: ReportOptions = ReportOptions()) -> Total:
    """Files, objections, their mean, the most common type and the mean intensity, as ``corpus_stats`` has them."""
    return Total(
        lambda calls: reports.corpus_sums(analyse_calls(calls, rules, options), rules.types),
        lambda sums: reports.corpus_row(sums, rules.types),
        least=tuple(reports.first_names(rules.types)),
    )


def categories(final: Callable[[DataFrame], DataFrame]) -> Total:
    """Rows per category of the final table that ``final`` makes of a batch of calls."""
    return Total(lambda calls: dashboard.category_distribution(final(calls)), lambda sums: sums, keys=("categoria",))


def runs(scored: Callable[[DataFrame], DataFrame], threshold: float) -> Total:
    """Chunks processed, detected, discarded and failed, of the scored chunks that ``scored`` makes of a batch of calls."""
    names = ("chunks", "detected", "failed", "discarded")

    def count(calls: DataFrame) -> DataFrame:
        counts = semantic.run_counts(scored(calls), threshold)
        return counts.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))

    return Total(count, lambda sums: sums)


def follow(stream: DataFrame, totals: Mapping[str, Total], path: str, checkpoint: str) -> StreamingQuery:
    """Bring the totals under ``path`` up to date with the calls that are new, and stop.

    ``stream`` has ``archivo, raw, parse_error``; rejects are not counted. ``checkpoint`` and ``path`` belong together.
    """

    def update(batch: DataFrame, number: int) -> None:
        calls = settle(batch.where("parse_error is null").drop("parse_error"))
        for name, total in totals.items():
            parts = total.count(calls)
            if number > 0:
                before = calls.sparkSession.read.schema(parts.schema).parquet(_place(path, name, number - 1))
                parts = parts.unionByName(before)
            merged = total.merged(parts)
            merged.coalesce(1).write.mode("overwrite").parquet(_place(path, name, number))  # one file: all or nothing

    return (
        stream.writeStream.foreachBatch(update)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _place(path: str, name: str, number: int) -> str:
    return f"{path}/{name}/batch={number}"


def figures(spark: SparkSession, total: Total, path: str, name: str) -> DataFrame:
    """The figures of a total after the last batch. Runs a job that looks for it."""
    tables = spark.read.parquet(f"{path}/{name}")
    last = tables.agg(F.max("batch")).first()[0]
    rows = tables.drop("batch")
    if last is not None:  # else no batch had a row
        rows = spark.read.schema(rows.schema).parquet(_place(path, name, last))
    return total.finish(rows)
