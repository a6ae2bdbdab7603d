"""Spelling variants: words one edit apart, found in dense tiles of code points, and the form each variant stands for.

Two words are near if exactly one inserted, deleted or replaced code point makes one the other. Then their common prefix
and their common suffix together reach the length b of the longer word minus one.

1. ``word_counts`` counts the words of all texts, per task in tables of bounded size.
2. The place of an edit lies in one of a few short ranges [lo, hi) of the longer word. Words that agree before lo and in
   their last b - hi code points, and are b or b - 1 long, make the tile of (b, lo). A range is two places wide, so a
   tile holds at most as many words as there are pairs and single letters; words longer than 2 * ``RANGES`` have
   ``RANGES`` wider ranges, so that a word is sent at most 2 * ``RANGES`` times.
3. Tiles arrive sorted and are laid out as two padded matrices of code points, aligned left and right. Blocks of their
   rows are compared with each other: the first difference from the left gives the common prefix, from the right the
   common suffix. A pair counts only in the tile of the range that holds its prefix, so it is met once.
4. What a task finds leaves it as one row per word and batch: number of near words and the best of them.

The form of a word is its near word of largest n, ties to the first in code-point order, if that n is at least ``ratio``
times its own; the root follows forms to the last by doubling. Counts grow along a chain, so chains are short.

Defined results: null texts have no words; a null id counts as an empty one; repeated rows count again. Words of any
length are compared whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tertulia.llm.common import slices
from tertulia.sources.staging import settle

LEAST_LENGTH, LEAST_COUNT, RATIO, LOSS = 5, 3, 2, 97
#: Most ranges of edit places of one length.
RANGES = 16
#: Distinct words a task holds while it counts, cells of code points compared at once, texts read at once.
HELD, CELLS, TEXTS = 400_000, 1 << 20, 256

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def _runs(least: int) -> re.Pattern:
    """Maximal runs, after A-Z are lower-cased, that are long enough."""
    return re.compile(f"[a-zÀ-ÿ]{{{least},}}")


def words_of(doc_id: int | None, text: str | None, runs: re.Pattern, loss: int = LOSS) -> Counter:
    """Occurrences of the words of a text; every ``loss``-th run by its checksum has lost a code point."""
    found = Counter(runs.findall((text or "").encode().translate(_LOWER).decode()))
    start = crc32(b":" if doc_id is None else b"%d:" % doc_id)
    lost = {run: h % len(run) for run in found if (h := crc32(run.encode(), start)) % loss == 0}
    counts = [(run, found.pop(run)) for run in lost]  # all are out before any result, itself such a run, comes in
    for run, count in counts:
        found[run[: lost[run]] + run[lost[run] + 1 :]] += count
    return found


def _counting(least: int, loss: int):
    runs = _runs(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            own = [(w, n) for w, n in held.items() if len(w) >= least]
            columns = [pa.array([w for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())]
            yield from pa.table(columns, schema=_COUNTS).to_batches(max_chunksize=8192)
            held.clear()

        for batch in batches:
            for part in slices([tuple(batch.columns)], TEXTS):
                for doc_id, text in zip(*(a.to_pylist() for a in part), strict=True):
                    for word, n in words_of(doc_id, text, runs, loss).items():
                        held[word] += n
                    if len(held) > HELD:
                        yield from out()
        yield from out()

    return count


def word_counts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    loss: int = LOSS,
) -> DataFrame:
    """(word, n) of the distinct words that are long and frequent enough."""
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    counted = own.mapInArrow(_counting(least_length, loss), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _width(b):
    """Places in a range of edits, for longer words of ``b`` code points; Spark columns and numbers alike."""
    if isinstance(b, int):
        return max(2, -(-b // RANGES))
    return F.greatest(F.lit(2), F.ceil(b / RANGES)).cast("int")


def tiles(words: DataFrame) -> DataFrame:
    """(b, lo, key, word, n): every word in all tiles that it belongs to."""
    length = F.char_length("word")
    longer = words.select("word", "n", length.alias("own"), F.explode(F.array(length, length + 1)).alias("b"))
    spread = longer.withColumn("width", _width(F.col("b")))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("b") - 1, F.col("width"))).alias("lo"))
    behind = F.greatest(F.col("b") - F.col("lo") - F.col("width"), F.lit(0))
    head = F.substring("word", F.lit(1), F.col("lo"))
    tail = F.substring("word", F.col("own") - behind + 1, behind)
    return spread.select("b", "lo", F.xxhash64("b", "lo", head, tail).alias("key"), "word", "n")


def _matrices(words: list[str], b: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points aligned left, and aligned right in reverse; unequal padding never agrees with a letter."""
    left = np.array(words, f"<U{b}").view(np.uint32).reshape(len(words), b)
    right = np.array([w[::-1] for w in words], f"<U{b}").view(np.uint32).reshape(len(words), b)
    return left, right


def _agreeing(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows."""
    same = one == other
    return np.where(same.all(axis=1), one.shape[1], same.argmin(axis=1))


def near_in_tiles(b: int, lo: np.ndarray, key: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, sorted by tile, that are near and whose edit lies in the range of their tile."""
    left, right = _matrices(words, b)
    sizes = (left != 0).sum(axis=1)
    width, first, second = _width(b), [], []
    step = max(1, CELLS // b)
    apart, rows = 1, np.arange(len(words) - 1)
    while len(rows):
        rows = rows[rows < len(words) - apart]
        rows = rows[(key[rows] == key[rows + apart]) & (lo[rows] == lo[rows + apart])]
        for at in range(0, len(rows), step):
            i = rows[at : at + step]
            k = i + apart
            ahead = _agreeing(left[i], left[k])
            behind = _agreeing(right[i], right[k])
            near = (np.maximum(sizes[i], sizes[k]) == b) & (ahead + behind >= b - 1)
            near &= (ahead >= lo[i]) & (ahead < lo[i] + width)
            first.append(i[near])
            second.append(k[near])
        apart += 1
    nothing = [np.zeros(0, np.int64)]
    return np.concatenate(first or nothing), np.concatenate(second or nothing)


def _best(rows: dict[str, list], edges: list[int]) -> Iterator[pa.RecordBatch]:
    """Near words of whole tiles; ``edges`` part the rows where b changes."""
    for start, end in zip(edges, edges[1:], strict=False):
        words, n = rows["word"][start:end], np.array(rows["n"][start:end], np.int64)
        lo, key = (np.array(rows[c][start:end], np.int64) for c in ("lo", "key"))
        one, other = near_in_tiles(rows["b"][start], lo, key, words)
        if not len(one):
            continue
        own, found = np.concatenate([one, other]), np.concatenate([other, one])
        distinct, number = np.unique(np.array(words), return_inverse=True)
        own, found = number[own], number[found]  # numbers follow code-point order
        counts = np.zeros(len(distinct), np.int64)
        counts[number] = n
        order = np.lexsort((found, -counts[found], own))
        own, found = own[order], found[order]
        each, starts, sizes = np.unique(own, return_index=True, return_counts=True)
        best = found[starts]
        columns = [distinct[each], sizes, counts[best], distinct[best]]
        yield from pa.table([pa.array(c) for c in columns], schema=_NEAR).to_batches(max_chunksize=8192)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words in tiles that arrive sorted; the last tile of a batch waits for the next one."""
    names = ("b", "lo", "key", "word", "n")
    rows: dict[str, list] = {c: [] for c in names}

    def cuts(columns: tuple[str, ...]) -> list[int]:
        found = np.zeros(max(0, len(rows["b"]) - 1), bool)
        for c in columns:
            values = np.array(rows[c], np.int64)
            found |= values[1:] != values[:-1]
        return (np.flatnonzero(found) + 1).tolist()

    for batch in batches:
        for c in names:
            rows[c] += batch.column(c).to_pylist()
        whole = cuts(("b", "lo", "key"))
        if whole:
            yield from _best(rows, [0, *(k for k in cuts(("b",)) if k < whole[-1]), whole[-1]])
            rows = {c: rows[c][whole[-1] :] for c in names}
    if rows["b"]:
        yield from _best(rows, [0, *cuts(("b",)), len(rows["b"])])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words; ``words`` is (word, n), each word once."""
    placed = tiles(words).repartition("key").sortWithinPartitions("b", "lo", "key")
    found = placed.mapInArrow(_compare, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    grouped = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return grouped.select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.form").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms of each word of ``forms`` (word, form); each round doubles the steps taken."""
    steps = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("last"))
        longer = settle(steps.join(further, "root", "left"))
        steps = longer.select("word", F.coalesce("last", "root").alias("root"))
        if longer.filter("last is not null").isEmpty():
            return steps


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n)."""
    known = settle(words.join(near_words(words), "word", "left"))
    taken = F.col("best_n") >= ratio * F.col("n")
    known = known.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(taken, F.col("best")).alias("form"),
        F.when(taken, F.col("best_n")).alias("form_n"),
    )
    last = roots(known.filter("form is not null"))
    out = known.join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
