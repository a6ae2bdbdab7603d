"""Jobs on tables that hold one row per turn.

``turn_no`` orders the turns of a call; numbers may have gaps. Neighbour windows run on blocks of numbers, so a call
that holds a large share of all rows is spread over as many tasks as it has blocks; a block's first and last turn get
their neighbours from the blocks beside it that have turns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tertulia.sources.staging import settle

BLOCK_TURNS = 1024
SUPERBLOCK = 1024


def _block(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(size))


def _sum_before(column: str, keys: Sequence[str], order: str) -> Column:
    rows = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(rows), F.lit(0))


def number_rows(
    df: DataFrame, order: str, keys: Sequence[str] = (), name: str = "turn_no", block: int = 65536
) -> DataFrame:
    """Dense positions from 0 by an increasing integer column, within ``keys`` (or over the whole table).

    Blocks of the order column are numbered on their own and shifted by the rows of the blocks before. Those
    sums are taken in two steps, within and over groups of blocks, so that the one window that holds all of a
    key sees one row per ``block * SUPERBLOCK`` places. The blocks' sizes, one row each, are settled, so the table is
    read once for them and once for its rows. Runs a job.
    """
    blocks, group = df.withColumn("_block", _block(F.col(order), block)), ["_block"]
    if keys:
        # A struct equals itself when its fields are null, so the join below is a plain one on the same key.
        blocks, group = blocks.withColumn("_key", F.struct(*keys)), ["_key", "_block"]
    outer = [*group[:-1], "_super"]
    counts = settle(
        blocks.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_super", _block(F.col("_block"), SUPERBLOCK))
    )
    inner = _sum_before("_rows", outer, "_block")
    totals = counts.groupBy(*outer).agg(F.sum("_rows").alias("_rows"))
    shift = (
        counts.select(*group, "_super", inner.alias("_near"))
        .join(totals.select(*outer, _sum_before("_rows", group[:-1], "_super").alias("_far")), outer)
        .select(*group, (F.col("_near") + F.col("_far")).alias("_shift"))
    )
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    return (
        blocks.withColumn("_inside", inside)
        .join(shift, group)
        .select(*df.columns, (F.col("_inside") + F.col("_shift")).cast("int").alias(name))
    )


def number_sorted(df: DataFrame, order: str, name: str) -> DataFrame:
    """Dense positions from 0 over the whole table by any sortable column, rows with equal values in any order.

    Rows are dealt by range, numbered inside each range, and shifted by the rows of the ranges before, of which there
    are as many as partitions. ``df`` should be settled: it is read for the ranges, the counts and the numbers.
    """
    ranged = settle(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    shift = counts.select("_range", _sum_before("_rows", [], "_range").alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    numbered = ranged.withColumn("_inside", inside).join(F.broadcast(shift), "_range")
    return numbered.select(*df.columns, (F.col("_inside") + F.col("_shift")).cast("int").alias(name))


def number_turns(turns: DataFrame, order: str, block: int = 65536) -> DataFrame:
    return number_rows(turns, order, ["archivo"], "turn_no", block)


def _block_edges(turns: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Per call and block, the ``values`` of the last turn of the block before and of the first of the one after."""
    value = F.struct("turn_no", *(v.alias(n) for n, v in values.items()))
    ends = turns.groupBy("archivo", "_block").agg(F.min(value).alias("_first"), F.max(value).alias("_last"))
    rows = Window.partitionBy("archivo").orderBy("_block")  # one row per block
    return ends.select(
        F.struct("archivo", "_block").alias("_place"),
        F.lag("_last").over(rows).alias("_before"),
        F.lead("_first").over(rows).alias("_after"),
    )


def _with_neighbours(
    turns: DataFrame, values: dict[str, Column], columns: Callable[[Column, Column], dict[str, Column]], block: int
) -> DataFrame:
    """Add ``columns(before, after)``: structs of the ``values`` of the turn before and the turn after, or null."""
    if block < 1:
        raise ValueError("a block needs at least one turn")
    placed = turns.withColumn("_block", _block(F.col("turn_no"), block))
    edges = _block_edges(placed, values)
    value = F.struct("turn_no", *(v.alias(n) for n, v in values.items()))
    order = Window.partitionBy("_place").orderBy("turn_no")
    keyed = placed.withColumn("_place", F.struct("archivo", "_block"))
    seen = keyed.withColumns({"_lag": F.lag(value).over(order), "_lead": F.lead(value).over(order)})
    near = columns(F.coalesce("_lag", "_before"), F.coalesce("_lead", "_after"))
    return seen.join(edges, "_place").select(*turns.columns, *(v.alias(n) for n, v in near.items()))


def with_context(turns: DataFrame, size: int = 100, block: int = BLOCK_TURNS) -> DataFrame:
    """Leading characters of the turn before and after, of any speaker; empty at the ends of the call."""

    def columns(before: Column, after: Column) -> dict[str, Column]:
        return {
            "context_before": F.coalesce(before["_text"], F.lit("")),
            "context_after": F.coalesce(after["_text"], F.lit("")),
        }

    return _with_neighbours(turns, {"_text": F.left(F.col("text"), F.lit(size))}, columns, block)


def with_duration(turns: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """``duration_sec``: time to the next turn in document order, never negative, 0 for the last turn."""

    def columns(before: Column, after: Column) -> dict[str, Column]:
        gap = after["_start"] - F.col("start_sec")
        return {"duration_sec": F.greatest(F.lit(0), F.coalesce(gap, F.lit(0)))}

    return _with_neighbours(turns, {"_start": F.col("start_sec")}, columns, block)


def with_client(turns: DataFrame, clients: DataFrame, default: int = 1) -> DataFrame:
    """Client speaker number per call from ``clients(archivo, client)``, the least of several; else the default."""
    known = clients.groupBy("archivo").agg(F.min("client").alias("client"))
    return turns.join(known, "archivo", "left").withColumn(
        "client", F.coalesce(F.col("client"), F.lit(default))
    )


def client_turns(turns: DataFrame, speaker: int | Column = 1) -> DataFrame:
    return turns.where(F.col("speaker_num") == speaker)
