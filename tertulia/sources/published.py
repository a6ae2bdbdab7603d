"""Tables that readers see whole: written to a folder of their own, then named by one small file.

A place holds ``data/<folder>`` and ``log/<folder>``. A version of the table exists once its log entry does, which is one
row in one file that appears by a rename; data without an entry is never read. So a failed, stopped or overlapping run
leaves readers with the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "version long, folder string, run string, replaces boolean"


def entries(spark: SparkSession, place: str) -> DataFrame:
    """``version, folder, run, replaces`` of all publications of a place; no rows where there are none."""
    try:
        return spark.read.schema(ENTRY).json(f"{place}/log/*/*.json")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def publish(
    df: DataFrame, place: str, run: str | None = None, append: bool = False, fmt: str = "parquet", **options: str
) -> bool:
    """Replace the table at ``place`` by ``df``, or add to it. Runs jobs.

    A ``run`` that has been published already is left alone, and the result is False: a repeated job or batch changes
    nothing. Of two replacements at the same time, one wins as a whole; additions at the same time all count. Folders of
    failed and replaced runs stay until the owner of the place removes them.
    """
    spark = df.sparkSession
    known = entries(spark, place)
    last, again = known.agg(
        F.coalesce(F.max("version"), F.lit(0)), F.count_if(F.col("run") == F.lit(run).cast("string"))
    ).first()
    if again:
        return False
    folder = uuid.uuid4().hex
    df.write.format(fmt).options(**options).save(f"{place}/data/{folder}")
    entry = spark.createDataFrame([(last + 1, folder, run, not append)], ENTRY)
    entry.coalesce(1).write.json(f"{place}/log/{folder}")
    return True


def published_folders(spark: SparkSession, place: str) -> list[str]:
    """The folders that make up the table now: names only, one per publication since the last replacement."""
    known = entries(spark, place)
    start = F.struct("version", "folder")
    replaced = known.where("replaces").agg(F.max(start).alias("_start"))
    current = known.join(F.broadcast(replaced), F.col("_start").isNull() | (start >= F.col("_start")))
    rows = current.where(F.col("_start").isNull() | ~F.col("replaces") | (F.col("folder") == F.col("_start.folder")))
    # A run that two jobs published at the same time counts once.
    named = rows.groupBy(F.coalesce("run", "folder"), F.col("run").isNull()).agg(F.min(start).alias("_first"))
    found = named.select("_first.folder").orderBy("_first").collect()
    return [f"{place}/data/{row.folder}" for row in found]


def read_published(
    spark: SparkSession, place: str, schema: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """The table as published last; no rows where nothing has been published."""
    folders = published_folders(spark, place)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).options(**options).load(folders)
