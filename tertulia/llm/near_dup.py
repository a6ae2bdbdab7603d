"""Near duplicates by MinHash: many universal-hash minima, banding, signature checks, and connected components.

A document's set is its distinct five-word shingles (A-Z lower-cased; with fewer words, the whole sequence as one).
Documents whose sets have a Jaccard similarity of at least ``linked`` percent are linked (op9: ``LINKED``). Bands,
rows and the least agreement of sketches follow from that percentage, see ``law``.

1. Every text becomes a sketch: size and fingerprint of its set, band keys of several minima each, and one byte of
   each minimum.
2. Equal sets are one class, represented by its least id; copies go no further.
3. Classes that share a band key form a bucket. Each is compared with the least of its bucket: linear in the bucket.
   Pairs whose sketches agree enough are confirmed on their full sets.
4. After the components of these links, only buckets that still hold several components can hide a link. Buckets of
   that kind which share a member make a cluster; each of its members goes there once, with its sketch and its full set.
   A cluster is cut into blocks of bounded size, and each pair of blocks is a task: pairs between components whose
   sketches agree enough are confirmed on the full sets there and then, and a link that joins two components makes them
   one. So a task emits fewer links than it has members, however many pairs it compares, and no pair is given up.

A link just at the percentage shares no bucket with probability ``UNSHARED`` at most and is refused by its sketch with
``REFUSED`` at most; both fall off steeply above. At 85 % these are (1 - 0.85**7)**30 = 9e-6 and 7e-7.

Defined results: null and empty texts have an empty set, size 0, and are linked with nothing. Rows with the same id
are one document. A null id is never linked: its component is null and it is kept. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tertulia.llm.common import slices
from tertulia.llm.components import components
from tertulia.llm.vocabulary import Memo
from tertulia.sources.staging import settle

SHINGLE, LINKED = 5, 85
#: Most minima of a sketch.
MINIMA = 240
#: Largest probability that a link just at the percentage shares no band, and that its sketches agree too little.
UNSHARED, REFUSED = 1e-5, 1e-6
#: Members of a cluster, and shingles of their sets, at most about, that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Shingles hashed at once.
STEP = 4096

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MIX, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32, _S56 = np.uint64(29), np.uint64(32), np.uint64(56)
_random = np.random.RandomState(20_240)
_FACTORS = _random.randint(0, 1 << 62, MINIMA, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.randint(0, 1 << 62, MINIMA, np.int64).astype(np.uint64) * np.uint64(3)
_PLACES = _random.randint(0, 1 << 62, SHINGLE, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH = "struct<n:long,left:long,right:long,keys:array<long>,marks:binary>"

_word_hashes = Memo(xxhash.xxh3_64_intdigest)


class Law(NamedTuple):
    """Percentage of a link, bands and rows of its sketches, and equal bytes from which a pair is confirmed."""

    linked: int
    bands: int
    rows: int
    agreeing: int


@cache
def law(linked: int) -> Law:
    """The longest bands of which at most ``MINIMA`` minima keep to ``UNSHARED``, and the most bytes within ``REFUSED``."""
    share = linked / 100
    for rows in range(MINIMA, 0, -1):
        lost = 1 - share**rows
        bands = 1 if lost == 0 else math.ceil(math.log(UNSHARED) / math.log(lost)) if lost < 1 else MINIMA + 1
        if bands * rows <= MINIMA:
            break
    else:
        raise ValueError(f"no bands of {MINIMA} minima find links at {linked} %")
    n, equal = bands * rows, share + (1 - share) / 256  # one byte in 256 agrees by chance
    below, agreeing = 0.0, 0
    while agreeing < n:
        below += math.comb(n, agreeing) * equal**agreeing * (1 - equal) ** (n - agreeing)
        if below > REFUSED:
            break
        agreeing += 1
    return Law(linked, bands, rows, agreeing)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _MIX
    x = (x ^ (x >> _S29)) * _MORE
    return x ^ (x >> _S32)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the set of a text."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes split at the six ASCII white spaces alone
    own = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    if not len(own):
        return own
    width = min(SHINGLE, len(own))
    count = len(own) - width + 1
    sums = np.full(count, width, np.uint64)
    for k in range(width):
        sums = _mixed(sums ^ (own[k : k + count] * _PLACES[k]))
    return np.unique(sums)


def minima(found: np.ndarray, count: int) -> np.ndarray:
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), STEP):
        values = np.multiply.outer(_FACTORS[:count], found[at : at + STEP])
        values += _OFFSETS[:count, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def sketch(text: str | None, by: Law) -> dict:
    found = shingles(text)
    if not len(found):
        return {"n": 0, "left": 0, "right": 0, "keys": [], "marks": b""}
    least = _mixed(minima(found, by.bands * by.rows))
    keys = np.arange(1, by.bands + 1, dtype=np.uint64) * _MIX
    for column in least.reshape(by.bands, by.rows).T:
        keys = _mixed(keys ^ column) + _MORE
    left, right = np.bitwise_xor.reduce(_mixed(found + _MORE)), found.sum(dtype=np.uint64)
    return {
        "n": len(found),
        "left": int(left.view(np.int64)),
        "right": int(right.view(np.int64)),
        "keys": keys.view(np.int64),
        "marks": (least >> _S56).astype(np.uint8).tobytes(),
    }


def _sketches(by: Law) -> Callable:
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct(
            [
                ("n", pa.int64()),
                ("left", pa.int64()),
                ("right", pa.int64()),
                ("keys", pa.list_(pa.int64())),
                ("marks", pa.binary()),
            ]
        )
        for batch in slices(batches):
            yield pa.array([sketch(t, by) for t in batch.to_pylist()], kind)

    return made


def _agree(by: Law) -> Callable:
    def agree(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        n = by.bands * by.rows
        for left, right in slices(batches, 2048):
            one, other = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, n) for x in (left, right))
            yield pa.array((one == other).sum(axis=1) >= by.agreeing)

    return agree


def _linked(by: Law) -> Callable:
    """Whether two texts are linked, on their full sets."""

    def linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = Memo(shingles, most=64, longest=1 << 30)
        for left, right in slices(batches, 64):
            out = []
            for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
                one, other = known[a or ""], shingles(b)
                both = len(np.intersect1d(one, other, assume_unique=True))
                out.append(both > 0 and 100 * both >= by.linked * (len(one) + len(other) - both))
            yield pa.array(out)

    return linked


def _sizes_allow(n: str, m: str, by: Law):
    """The smaller set is large enough for a link with the larger."""
    return 100 * F.least(n, m) >= by.linked * F.greatest(n, m)


def _confirmed(pairs: DataFrame, texts: DataFrame, by: Law) -> DataFrame:
    """The pairs (u, v) that are linked on their full sets; ``texts`` is (id, text)."""
    used = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    own = texts.join(used, "id", "left_semi")
    joined = pairs.join(own.select(F.col("id").alias("u"), F.col("text").alias("one")), "u").join(
        own.select(F.col("id").alias("v"), F.col("text").alias("other")), "v"
    )
    return joined.filter(F.arrow_udf(_linked(by), "boolean")("one", "other")).select("u", "v").distinct()


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, id, size, first) of the members of all buckets with several classes."""
    keyed = classes.select(F.explode("keys").alias("key"), "id")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("first")).filter("size > 1")
    return keyed.join(sizes, "key")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of several ranges, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def spanning_links(
    ids: np.ndarray, parts: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray, by: Law
) -> list[tuple[int, int]]:
    """Links between components that make them one, as many as it takes; ``blocks`` of two numbers meet only each other."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked, parts, found = np.zeros(len(kinds), bool), parts.copy(), []
    within = blocks.min() == blocks.max()
    for i in range(len(ids) - 1):
        near = 100 * np.minimum(sizes[i + 1 :], sizes[i]) >= by.linked * np.maximum(sizes[i + 1 :], sizes[i])
        others = np.flatnonzero((parts[i + 1 :] != parts[i]) & near & (within | (blocks[i + 1 :] != blocks[i]))) + i + 1
        others = others[(marks[others] == marks[i]).sum(axis=1) >= by.agreeing]
        if not len(others):
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        marked[own] = True
        counts = sizes[others]
        shared = marked[flat[_ranges(starts[others], counts)]]
        both = np.add.reduceat(shared, np.cumsum(counts) - counts, dtype=np.int64)
        marked[own] = False
        for j in others[100 * both >= by.linked * (sizes[i] + counts - both)].tolist():
            if parts[j] != parts[i]:
                found.append((int(ids[i]), int(ids[j])))
                parts[parts == parts[j]] = parts[i]
    return found


def _compare(by: Law) -> Callable:
    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.filter(pc.greater(pc.binary_length(rows["shingles"]), 0)).sort_by("id")
        found = []
        if rows.num_rows > 1:
            ids, parts, blocks = (rows[c].to_numpy() for c in ("id", "component", "block"))
            marks = np.frombuffer(b"".join(rows["marks"].to_pylist()), np.uint8).reshape(len(ids), -1)
            sets = [np.frombuffer(b, np.uint64) for b in rows["shingles"].to_pylist()]
            found = spanning_links(ids, parts, marks, sets, blocks, by)
        return pa.table([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return compare


def _full_sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in slices(batches):
        yield pa.array([shingles(t).tobytes() for t in batch.to_pylist()], pa.binary())


def _unresolved(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, component, cluster) of the members of buckets that hold several components."""
    placed = members.select("key", "id").join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    several = placed.groupBy("key").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.min("id").alias("first")
    )
    held = settle(placed.join(several.filter("a <> b").select("key", "first"), "key"))
    clusters = components(held.select(F.col("first").alias("u"), F.col("id").alias("v")))
    found = held.select("id", "component").distinct()
    return found.join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id")


def _hidden_links(members: DataFrame, classes: DataFrame, parts: DataFrame, texts: DataFrame, by: Law) -> DataFrame:
    """Links that join components which share a bucket; ``texts`` is (id, text)."""
    rows = settle(_unresolved(members, parts).join(classes.select("id", "n", "marks"), "id"))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = rows.drop("n").join(sizes.select("cluster", blocks.alias("blocks")), "cluster")
    rows = rows.join(texts.join(rows.select("id").distinct(), "id", "left_semi"), "id")
    rows = rows.withColumn("shingles", F.arrow_udf(_full_sets, "binary")("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("partner")
    rows = rows.select("cluster", "id", "component", "marks", "shingles", "block", partner)
    rows = rows.withColumn("low", F.least("block", "partner")).withColumn("high", F.greatest("block", "partner"))
    return rows.groupBy("cluster", "low", "high").applyInArrow(_compare(by), "u long, v long").distinct()


def _same_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links from an id that several different texts bear to the classes of those texts."""
    found = F.xxhash64("left", "right", "n")
    twice = rows.filter("n > 0").groupBy("id").agg(F.min(found).alias("a"), F.max(found).alias("b")).filter("a <> b")
    bearers = rows.filter("n > 0").join(twice.select("id"), "id", "left_semi").select("left", "right", "n", F.col("id").alias("u"))
    firsts = classes.select("left", "right", "n", F.col("id").alias("v"))
    return bearers.join(firsts, ["left", "right", "n"]).select("u", "v")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", linked: int = LINKED) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    by = law(linked)
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = settle(own.select("id", F.arrow_udf(_sketches(by), SKETCH)("text").alias("s")).select("id", "s.*"))
    same = ["left", "right", "n"]
    classes = rows.filter("n > 0 and id is not null").groupBy(*same)
    classes = settle(
        classes.agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("marks").alias("marks"))
    )
    members = settle(_buckets(classes))
    marks = classes.select("id", "n", "marks")
    stars = members.filter("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v")).distinct()
    tried = stars.join(marks.toDF("u", "n", "one"), "u").join(marks.toDF("v", "m", "other"), "v")
    tried = tried.filter(_sizes_allow("n", "m", by)).filter(F.arrow_udf(_agree(by), "boolean")("one", "other"))
    tried = settle(tried.select("u", "v"))
    links = settle(_confirmed(tried, own, by).union(_same_ids(rows, classes)))
    parts = settle(components(links))
    more = settle(_hidden_links(members, classes, parts, own, by))
    if not more.isEmpty():
        parts = settle(components(parts.toDF("u", "v").union(more)))
    found = classes.select(*same, F.col("id").alias("first")).join(parts.toDF("first", "component"), "first", "left")
    found = found.select(*same, F.coalesce("component", "first").alias("component"))
    component = F.coalesce("component", "id").alias("component_id")
    joined = rows.select("id", *same).join(found, same, "left")
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        F.col("id").eqNullSafe(F.when(F.col("id").isNotNull(), component)).alias("kept"),
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", linked: int = LINKED) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, and one of rows that repeat its id and text."""
    dropped = near_duplicates(docs, doc_id, text, linked).filter("not kept").select(F.col("doc_id").alias("dropped__"))
    rest = docs.join(dropped.distinct(), F.col(doc_id).cast("long") == F.col("dropped__"), "left_anti")
    return rest.dropDuplicates([doc_id, text])
