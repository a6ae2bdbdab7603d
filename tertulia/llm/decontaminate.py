"""Documents that contain benchmark items: one Aho-Corasick automaton over the windows of normalised items.

Normalised: A-Z lower-cased; words are runs of digits, lower-case letters and characters beyond ASCII; one space
between words. A window is ``size`` consecutive words of an item; an item with fewer words, but not none, is one
window. The automaton reads each normalised text once, and hits are mapped to words and offsets of the original.

Defined results: null and empty texts have no words and no hits; items without words or without an id never occur, and
the words of the latter are not hit by them; repeated item rows
and equal windows of different items count for each item. Rows of ``docs`` are never merged, other columns stay, and
a column named like the result is replaced. Without items nothing is contaminated.

Items are shipped to the executors in parts of about ``PART_BYTES``, so the automaton of a task stays bounded. A
benchmark beyond that size is scanned part by part, with the same result: each part is read, broadcast, scanned, its
hits settled with those before, and dropped, so driver and workers hold one part. That runs a job for each part but
the last when ``with_hits`` is called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia.llm.common import slices
from tertulia.sources.staging import settle

WINDOW_WORDS = 13
PART_BYTES = 8 << 20
HITS = "struct<n_words:long,words:array<struct<first:int,last:int,start:int,end:int>>,items:array<string>>"

#: Bytes of words stay, capitals are lower-cased, all other ASCII becomes a space.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def windows_of(text: str | None, size: int) -> list[str]:
    """Windows as strings with a space at both ends; each byte is one character."""
    words = words_of(text)
    if not words:
        return []
    last = max(1, len(words) - size + 1)
    return [f" {b' '.join(words[i : i + size]).decode('latin-1')} " for i in range(last)]


class Scanner:
    """Finds all windows of the items in a text."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        import ahocorasick

        owners: dict[str, set[str]] = defaultdict(set)
        for item, text in items:
            for window in windows_of(text, size):
                owners[window].add(item)
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.automaton.add_word(window, (window.count(" ") - 1, tuple(ids)))
        self.found_any = bool(owners)
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> dict:
        raw = (text or "").encode()
        spaced = raw.translate(_NORMAL)
        words = spaced.split()
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        if words and self.found_any:
            normal = f" {b' '.join(words).decode('latin-1')} "
            gaps = None
            for end, (length, ids) in self.automaton.iter(normal):
                if gaps is None:  # number of the word that begins after each space
                    gaps = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 0x20)
                last = int(np.searchsorted(gaps, end)) - 1
                hits.append((last - length + 1, last))
                items.update(ids)
        return {"n_words": len(words), "words": self._original(raw, spaced, hits), "items": sorted(items)}

    @staticmethod
    def _original(raw: bytes, spaced: bytes, hits: list[tuple[int, int]]) -> list[dict]:
        """Unions of the hit word ranges, with code points of the original."""
        if not hits:
            return []
        ranges: list[list[int]] = []
        for first, last in sorted(set(hits)):
            if ranges and first <= ranges[-1][1] + 1:
                ranges[-1][1] = max(last, ranges[-1][1])
            else:
                ranges.append([first, last])
        inside = np.concatenate(([False], np.frombuffer(spaced, np.uint8) != 0x20, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        points = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)))
        return [
            {"first": a, "last": b, "start": int(points[starts[a]]), "end": int(points[ends[b]])} for a, b in ranges
        ]


def _parts(benchmark: DataFrame, item: str, text: str, part_bytes: int) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """The items in parts of bounded size, read through one partition of the driver's iterator at a time, and whether
    another part follows; one empty part without items."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    rows = rows.filter("i is not null and t is not null").distinct()
    part: list[tuple[str, str]] = []
    size = 0
    for row in rows.toLocalIterator():
        if size >= part_bytes:
            yield part, True
            part, size = [], 0
        part.append((row["i"], row["t"]))
        size += len(row["t"].encode())
    yield part, False


def _scan(items, size: int):
    @F.arrow_udf(HITS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = None
        kind = pa.struct(
            [
                ("n_words", pa.int64()),
                ("words", pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")]))),
                ("items", pa.list_(pa.string())),
            ]
        )
        for batch in slices(batches):
            scanner = scanner or Scanner(items.value, size)
            yield pa.array([scanner.scan(t) for t in batch.to_pylist()], kind)

    return scan


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW_WORDS,
    part_bytes: int = PART_BYTES,
    name: str = "hits",
) -> DataFrame:
    """``docs`` with (n_words, hit ranges of words with their code points, ids of the items that occur)."""
    context = docs.sparkSession.sparkContext
    before, own = f"{name}__before", f"{name}__own"
    out, first = docs, True
    for part, more in _parts(benchmark, item, item_text, part_bytes):
        held = context.broadcast(part)
        out = out.withColumn(name if first else own, _scan(held, size)(F.col(text)))
        if not first:
            out = _united(out, before, own, name)
        if more:
            out = settle(out.withColumnRenamed(name, before))
            held.destroy()
            first = False
    return out


def _united(df: DataFrame, before: str, own: str, name: str) -> DataFrame:
    """The hits of two columns as one."""
    one, other = F.col(before), F.col(own)
    hits = F.struct(
        one["n_words"].alias("n_words"),
        _union(F.concat(one["words"], other["words"])).alias("words"),
        F.array_sort(F.array_union(one["items"], other["items"])).alias("items"),
    )
    return df.withColumn(name, hits).drop(before, own)


def _union(ranges: Column) -> Column:
    """Ranges that no other one covers or begins before, joined where they overlap or touch."""
    ordered = F.array_sort(ranges)
    return F.aggregate(
        ordered,
        F.slice(ordered, 1, 0),
        lambda done, r: F.when(
            (F.size(done) > 0) & (r["first"] <= F.element_at(done, -1)["last"] + 1),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["first"].alias("first"),
                        F.greatest(F.element_at(done, -1)["last"], r["last"]).alias("last"),
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], r["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(r))),
    )


def n_hit(hits: Column) -> Column:
    """Words inside any occurrence."""
    return F.aggregate(hits["words"], F.lit(0).cast("long"), lambda n, r: n + (r["last"] - r["first"] + 1).cast("long"))


def is_contaminated(hits: Column) -> Column:
    """At least a twentieth of the words is hit."""
    hit = n_hit(hits)
    return (hit > 0) & (hit * 20 >= hits["n_words"])
