"""A transcript folder as a stream.

A file is a whole call and a call is analysed within its row, so these streams keep no state and need no
watermark. Each run takes the files that came since the last one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tertulia.config import ReportOptions, RuleSet
from tertulia.operators.reports import call_documents
from tertulia.plans.objections import list_objections
from tertulia.sources.folder_source import FILES_PER_TASK, TranscriptFolder, is_readable, qualified
from tertulia.sources.staging import settle
from tertulia.sources.transcripts import MAX_FILE_BYTES, checked_text, decoded, file_key, large_files


def stream_transcripts(
    spark: SparkSession,
    path: str,
    seen: str | None = None,
    files_per_task: int = FILES_PER_TASK,
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """``archivo, raw, parse_error`` of new ``*.txt`` files, with the rows ``read_transcripts`` gives: files of zero bytes
    and files that cannot be used come once, like all others.

    The names met so far are kept in the folder ``seen``, by default ``_seen`` in the streamed folder (which must then be
    one folder, without ``*``). A restarted query needs it as it needs its checkpoint. Stores that Python workers cannot
    open are streamed by Spark's own readers, which skip files of zero bytes.
    """
    place = qualified(spark, path)
    if not is_readable(place):
        return _stream_by_spark(spark, place, max_bytes)
    if seen is None and "*" in path:
        raise ValueError("several folders need a folder `seen`")
    spark.dataSource.register(TranscriptFolder)
    files = spark.readStream.format(TranscriptFolder.name()).options(maxBytes=max_bytes, filesPerTask=files_per_task)
    return decoded(files.option("seen", qualified(spark, seen or f"{place}/_seen")).load(place))


def _stream_by_spark(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Texts, and the listing for files that are too large, as two streams over the folder, united."""
    limit = {"maxFilesPerTrigger": 100_000, "pathGlobFilter": "*.txt"}
    files = spark.readStream.options(**limit).text(path, wholetext=True)
    usable = files.where(F.col("_metadata.file_size") <= max_bytes)
    listing = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary")
    names = listing.format("binaryFile").options(**limit).load(path)
    texts = usable.select(file_key().alias("archivo"), *checked_text(F.col("value")))
    return texts.unionByName(large_files(names, max_bytes))


def append_to(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Process what is there, append it under ``path`` and stop; ``checkpoint`` lies on shared storage."""
    return (
        stream.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )


def _good(stream: DataFrame) -> DataFrame:
    return stream.where("parse_error is null").drop("parse_error")


def stream_objections(stream: DataFrame, rules: RuleSet, client_speaker: int = 1) -> DataFrame:
    return list_objections(_good(stream), rules, client_speaker)


def stream_documents(stream: DataFrame, rules: RuleSet, options: ReportOptions = ReportOptions()) -> DataFrame:
    return call_documents(_good(stream), rules, options)


def stream_rejects(stream: DataFrame) -> DataFrame:
    return stream.where("parse_error is not null").select("archivo", "parse_error")


def transform_batches(
    stream: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Jobs that join or aggregate per call, run on each batch of new files.

    Results lie under ``path/results`` and the batch's rejects under ``path/rejects``, by batch, so a repeated batch
    replaces its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = settle(batch)
        job(_good(batch)).write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        stream_rejects(batch).write.mode("overwrite").parquet(f"{path}/rejects/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
