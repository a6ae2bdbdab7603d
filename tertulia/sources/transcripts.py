"""Transcript folders in, cleaned transcripts and call reports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tertulia.functions.text import unify_newlines
from tertulia.sources.folder_source import TranscriptFolder, is_readable, qualified

# One value of a Spark row cannot pass 2 GB; a larger file is reported, not read.
MAX_FILE_BYTES = 1 << 30


def file_key(name: Column | None = None) -> Column:
    """Bare file name. The metadata column is partly URL-encoded, so it is decoded here."""
    name = F.col("_metadata.file_name") if name is None else name
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_transcripts(
    spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES, tasks: int | None = None
) -> DataFrame:
    """``archivo, raw, parse_error``: one row per ``*.txt`` file of the folder, subfolders left out.

    Files that cannot be used are kept as rows with ``parse_error`` set; see ``with_rejects``: files that are too large
    or cannot be opened, and files that are no valid UTF-8. A file of zero bytes is an empty transcript. The folder is
    listed by the ``tasks`` that read it (by default as many as a shuffle has partitions), not by the driver; stores that
    Python workers cannot open are listed and read by Spark's own readers.
    """
    place = qualified(spark, path)
    if not is_readable(place):
        return _read_by_spark(spark, place, max_bytes)
    spark.dataSource.register(TranscriptFolder)
    count = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return decoded(spark.read.format(TranscriptFolder.name()).options(maxBytes=max_bytes, tasks=count).load(place))


def decoded(files: DataFrame, *others: str) -> DataFrame:
    """``archivo, raw, parse_error`` of the rows of the folder source, after ``others`` of their columns."""
    raw, invalid = checked_text(F.col("value").cast("string"))
    return files.select(*others, "archivo", raw, F.coalesce("parse_error", invalid).alias("parse_error"))


def _read_by_spark(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Spark's readers skip files of zero bytes, so those are what the listing, which the driver holds for such a scan
    anyway, has beyond the files with content."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    usable = files.where(F.col("_metadata.file_size") <= max_bytes).select(
        file_key().alias("archivo"), *checked_text(F.col("value"))
    )
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    listed = spark.createDataFrame([(name,) for name in files.inputFiles()], "path string")
    place = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/*", "/")
    known = names.select(F.regexp_replace("path", "^[a-z0-9]+:/*", "/").alias("place"))
    empty = listed.select(place.alias("place")).join(known, "place", "left_anti")
    return usable.unionByName(large_files(names, max_bytes)).unionByName(
        empty.select(
            F.regexp_extract("place", "[^/]*$", 0).alias("archivo"),
            F.lit("").alias("raw"),
            F.lit(None).cast("string").alias("parse_error"),
        )
    )


def large_files(names: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files too large for one value as rejects, from a listing of files."""
    return names.where(F.col("length") > max_bytes).select(
        F.regexp_extract("path", "[^/]*$", 0).alias("archivo"),
        F.lit(None).cast("string").alias("raw"),
        F.lit("file too large").alias("parse_error"),
    )


def checked_text(value: Column) -> list[Column]:
    valid = F.is_valid_utf8(value)
    return [
        F.when(valid, unify_newlines(value)).alias("raw"),
        F.when(~valid, F.lit("not valid UTF-8")).alias("parse_error"),
    ]


def with_rejects(df: DataFrame, column: str = "parse_error") -> tuple[DataFrame, DataFrame]:
    """Split rows into the good ones and those whose error column is set."""
    return df.where(F.col(column).isNull()).drop(column), df.where(F.col(column).isNotNull())


def write_clean(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("archivo", "clean").write.mode(mode).parquet(path)


def write_reports(df: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "json") -> None:
    """One nested document per row."""
    df.write.mode(mode).format(fmt).save(path)
