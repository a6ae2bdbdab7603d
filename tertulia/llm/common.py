"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in the contracts: space, tab, and the four line controls after it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def sha256(text: Column) -> Column:
    """Lowercase hex digest of the UTF-8 bytes."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined in the order given."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body or its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """The Arrow arrays of batches, or tuples of arrays, ``rows`` at a time, so that few rows are Python objects.

    Workers are used again by later stages, so what Arrow holds in reserve is given back at the end.
    """
    for batch in batches:
        several = isinstance(batch, tuple)
        for at in range(0, len(batch[0] if several else batch), rows):
            yield tuple(a.slice(at, rows) for a in batch) if several else batch.slice(at, rows)
    batch = None
    pa.default_memory_pool().release_unused()
