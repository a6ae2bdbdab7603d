"""Delimited tables, detection files and column housekeeping."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tertulia import schemas

SEPARATOR = ";"


def read_table(spark: SparkSession, path: str, schema: str, sep: str = SEPARATOR) -> DataFrame:
    """Delimited text with a header; quoted values may hold the separator and line ends."""
    return (
        spark.read.schema(schema)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    )


def write_final(df: DataFrame, path: str, sep: str = SEPARATOR, mode: str = "errorifexists") -> None:
    """The reading side's separator must be the same; ``SEPARATOR`` is the default of both."""
    df.write.mode(mode).csv(
        path, header=True, sep=sep, quote='"', escape='"', encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def read_detections(
    spark: SparkSession, path: str, schema: str = schemas.DETECTIONS, json_lines: bool = False
) -> DataFrame:
    """Detections from JSON arrays, or from JSON lines, which Spark can also split within a file.

    A missing path and malformed JSON raise.
    """
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("multiLine", not json_lines).json(path)


def plain_name(name: str) -> str:
    """The ASCII characters of a name's compatibility decomposition, stripped and in lower case."""
    return "".join(filter(str.isascii, unicodedata.normalize("NFKD", name))).strip().lower()


def normalise_columns(df: DataFrame) -> DataFrame:
    """All column names as plain ones; names that become equal are an error."""
    names = [plain_name(name) for name in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide: {names}")
    return df.toDF(*names)


def order_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, then the others in their order."""
    first = [name for name in wanted if name in df.columns]
    return df.select(*first, *[name for name in df.columns if name not in first])
