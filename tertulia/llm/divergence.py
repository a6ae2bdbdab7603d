"""How far the sources of a language differ in their words: an Arrow pipeline of exact counts and divergences.

1. Inside ``mapInArrow`` a slice of texts is lower-cased (A-Z alone), split at everything that is no letter,
   dictionary-encoded and counted by a hash grouping of (row, term) codes. The counts of a task are merged until
   ``HELD`` rows are reached, then leave it, so a task's memory is bounded and a hot source costs no more than others.
2. Partial counts meet by (language, term): one exchange. Terms in at least ``least_docs`` documents of their language
   are kept, each with its counts by source.
3. The kept terms of a language are dealt into columnar shards of some ``SHARD`` terms. A shard is a dense matrix of
   terms by sources; it gives its share of every divergence between two sources, and its leading terms of each source.
   Shares are summed and leading terms are merged.

Smoothed shares are in billionths: p = 1 + floor(10^9 * (count + 2) / (N + 2V)), N the group's occurrences of kept terms
and V the kept terms of its language. A divergence is the sum of floor((p - q)^2 / (p + q)). All of it is integer
arithmetic, exact for groups of up to 9e15 occurrences.

Defined results: null texts, languages and sources are empty ones. Each row is a document, repeated rows included. A
group whose texts hold no kept term still has all its pairs; a language without kept terms has divergences of 0 and no
leading terms. Ties go to the item that comes first in UTF-8 order. Other columns are ignored, whatever they are named;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tertulia.sources.staging import settle

#: What lies between terms: every ASCII character that is no letter.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, LEADING = 10, 10
#: Bytes of text counted at once, rows of partial counts a task holds, terms of a columnar shard, cells compared at once.
SLICE, HELD, SHARD, CELLS = 8 << 20, 600_000, 2048, 1 << 20

_PARTS = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]
)
_FOUND = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]
)
PARTS = "lang string, source string, term string, n long, docs long"
FOUND = "lang string, source string, part string, item string, value long"


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``SLICE`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:], strict=False):
        if end > start:
            yield batch.slice(start, end - start)


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    encoded = pc.dictionary_encode(pc.fill_null(column, ""))
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.cast(pa.string())


def count_terms(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each (language, source, term); the empty term stands for the group itself."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), BETWEEN)
    terms, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(terms), 0)
    terms, rows = terms.filter(real), rows.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, names = _coded(terms)
    langs, lang_names = _coded(batch.column("lang"))
    sources, source_names = _coded(batch.column("source"))
    groups = langs * len(source_names) + sources
    width = max(1, len(names))
    in_row = pa.table({"key": rows * width + codes}).group_by("key").aggregate([([], "count_all")])
    keys = in_row["key"].to_numpy()
    in_group = (
        pa.table({"key": groups[keys // width] * width + keys % width, "n": in_row["count_all"]})
        .group_by("key")
        .aggregate([("n", "sum"), ([], "count_all")])
    )
    keys, own = in_group["key"].to_numpy(), np.unique(groups)
    group = np.concatenate([keys // width, own])
    nothing = pa.array(np.zeros(len(own), np.int64))
    return pa.table(
        [
            lang_names.take(pa.array(group // len(source_names))),
            source_names.take(pa.array(group % len(source_names))),
            pa.concat_arrays([names.take(pa.array(keys % width)), pa.array([""] * len(own), pa.string())]),
            pa.concat_arrays([in_group["n_sum"].combine_chunks(), nothing]),
            pa.concat_arrays([in_group["count_all"].combine_chunks().cast(pa.int64()), nothing]),
        ],
        schema=_PARTS,
    )


def _merged(tables: list[pa.Table]) -> pa.Table:
    if len(tables) == 1:
        return tables[0]
    together = pa.concat_tables(tables).group_by(["lang", "source", "term"])
    return together.aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(_PARTS.names)


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        for piece in _pieces(batch):
            held.append(count_terms(piece))
            if sum(t.num_rows for t in held) > HELD:
                held = [_merged(held)]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches(max_chunksize=8192)
    if held:
        yield from _merged(held).to_batches(max_chunksize=8192)


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * (counts + 2) / total), by long division so that nothing overflows."""
    whole, rest = np.divmod(counts + 2, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p - q
    return apart * apart // (p + q)


def _leading(values: np.ndarray, at: np.ndarray, terms: list[str], most: int) -> list[int]:
    """Places of the largest values among ``at``, ties by term."""
    if len(at) > most:
        least = np.partition(values[at], len(at) - most)[len(at) - most]
        at = at[values[at] >= least]
    return sorted(at.tolist(), key=lambda k: (-values[k], terms[k].encode()))[:most]


def _shard(leading: int) -> Callable:
    def shard(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = right["sources"][0].as_py()
        totals = np.array(right["totals"][0].as_py(), np.int64)
        kept, count = right["kept"][0].as_py(), len(names)
        terms = left["term"].to_pylist()
        lists = left["counts"].combine_chunks()
        cells = pc.list_flatten(lists)
        rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        columns = pc.index_in(pc.struct_field(cells, "source"), value_set=pa.array(names)).to_numpy(zero_copy_only=False)
        numbers = pc.struct_field(cells, "n").to_numpy(zero_copy_only=False)
        order = np.argsort(rows, kind="stable")
        rows, columns, numbers = rows[order], columns[order], numbers[order]
        sums = np.zeros((count, count), np.int64)
        best: list[list[tuple[int, str]]] = [[] for _ in names]
        step = max(1, CELLS // count)
        for at in range(0, len(terms), step):
            own = slice(*np.searchsorted(rows, [at, at + step]))
            dense = np.zeros((min(step, len(terms) - at), count), np.int64)
            dense[rows[own] - at, columns[own]] = numbers[own]
            p = shares(dense, totals + 2 * kept)
            q = shares(dense.sum(axis=1), int(totals.sum()) + 2 * kept)
            for i in range(count):
                sums[i, i + 1 :] += distances(p[:, i : i + 1], p[:, i + 1 :]).sum(axis=0)
                values = distances(p[:, i], q)
                more = np.flatnonzero((dense[:, i] > 0) & (p[:, i] > q))
                best[i] += [(int(values[k]), terms[at + k]) for k in _leading(values, more, terms[at : at + step], leading)]
        sums += sums.T
        found = [(names[i], "pair", names[k], int(sums[i, k])) for i in range(count) for k in range(count) if i != k]
        for i, several in enumerate(best):
            several.sort(key=lambda e: (-e[0], e[1].encode()))
            found += [(names[i], "term", term, value) for value, term in several[:leading]]
        columns_out = list(zip(*found, strict=True)) or [[]] * 4
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.string()), *map(pa.array, columns_out)], schema=_FOUND)

    return shard


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, lang="lang", source="source", text="text") -> DataFrame:
    """(lang, term, docs, counts by source) of the kept terms; the empty term lists the sources of a language."""
    own = docs.select(*(F.col(c).cast("string").alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    parts = own.mapInArrow(partial_counts, PARTS).repartition("lang", "term")
    merged = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = merged.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts")
    )
    return terms.filter((F.col("docs") >= least_docs) | (F.col("term") == ""))


def _totals(kept: DataFrame) -> DataFrame:
    """One row per language: number of kept terms, and its sources with their occurrences, by name."""
    flat = kept.select("lang", "term", F.explode("counts").alias("c")).groupBy("lang", "c.source")
    by_source = flat.agg(F.sum("c.n").alias("n")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("of"))
    sizes = kept.groupBy("lang").agg(F.count(F.when(F.col("term") != "", 1)).alias("kept"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("kept") / SHARD)).cast("int")
    return by_source.join(sizes, "lang").select(
        "lang", "kept", shards.alias("shards"), F.col("of.source").alias("sources"), F.col("of.n").alias("totals")
    )


def audit(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    leading: int = LEADING,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences from all other sources, and the leading terms of each source."""
    kept = settle(kept_terms(docs, least_docs, lang, source, text))
    totals = settle(_totals(kept))
    terms = kept.filter("term <> ''").join(totals.select("lang", "shards"), "lang")
    terms = terms.select("lang", F.pmod(F.xxhash64("term"), "shards").cast("int").alias("shard"), "term", "counts")
    each = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    everywhere = totals.select(F.col("lang").alias("lang"), each, "kept", "sources", "totals")
    found = terms.groupBy("lang", "shard").cogroup(everywhere.groupBy("lang", "shard")).applyInArrow(_shard(leading), FOUND)
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= leading))
