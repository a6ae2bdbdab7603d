"""Shards of near-equal bytes by a k-d tree over document metadata.

Documents with equal texts are one unit; a unit over ``WHOLE_SHARE`` of a shard is dealt into smaller ones by row, so
no group of copies can unbalance the tree. A node that has to hold k shards is split along its widest dimension (log
size, language and source, each scaled to the whole table) at the weighted median, or for odd k at the weighted
quantile that gives both sides their share, until each leaf has the bytes of one shard.

Medians are found by histograms: bins of the dimension, and inside the bin of the median two levels of 4,096 bins of
a hash of the unit. Every pass is one partial aggregation over all nodes of a level, and the driver receives at most
nodes x 4,096 sums. Units that the hash bins cannot tell apart stay on one side.

Defined results: null texts have no bytes of text (size 8) and checksum 0; null ids, languages and sources are values
like any other; repeated rows are rows of their own, each with its slot; other columns are ignored. An empty table
gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tertulia.sources.staging import settle

ROW_BYTES = 8
#: Part of a shard's bytes up to which equal texts stay together.
WHOLE_SHARE = 0.05
VALUE_BINS, HASH_BITS = 4096, 12
DIMENSIONS = ("size_dim", "lang_dim", "source_dim")
#: Rows numbered by one window, and most windows of a shard.
NUMBERED, NUMBERINGS = 20_000, 4096


@dataclass
class Node:
    """A box that holds ``count`` shards from ``first`` on; a split sends units below the cut to ``low``."""

    first: int
    count: int
    dimension: str = ""
    start: float = 0.0
    width: float = 1.0
    bin: int = 0
    prefix: int = 0
    low: Node | None = None
    high: Node | None = None
    total: float | None = None

    def bins(self) -> Column:
        place = (F.col(self.dimension) - self.start) / self.width * VALUE_BINS
        return F.least(F.floor(place).cast("int"), F.lit(VALUE_BINS - 1))

    def below(self) -> Column:
        tie = F.shiftrightunsigned("tie", 64 - 2 * HASH_BITS)
        return (self.bins() < self.bin) | ((self.bins() == self.bin) & (tie < self.prefix))

    def leaves(self) -> list[Node]:
        return [self] if self.low is None else self.low.leaves() + self.high.leaves()

    def place(self, of_leaf) -> Column:
        """``of_leaf(leaf)`` for the leaf that a unit falls into."""
        if self.low is None:
            return of_leaf(self)
        return F.when(self.below(), self.low.place(of_leaf)).otherwise(self.high.place(of_leaf))


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _scaled_code(value: Column) -> Column:
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) / float(1 << 32)


def shard(
    docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    body = F.col(text)
    rows = settle(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            text_size(body).alias("size"),
            F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(body, F.isnull(body)).alias("same"),
            _scaled_code(F.col(lang)).alias("lang_dim"),
            _scaled_code(F.col(source)).alias("source_dim"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    if not count:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    rows = _with_pieces(rows, total / shards)
    units = settle(
        rows.groupBy("same", "piece").agg(
            F.sum("size").alias("weight"),
            F.log2(F.avg("size")).alias("size_dim"),
            F.min("lang_dim").alias("lang_dim"),
            F.min("source_dim").alias("source_dim"),
        )
    ).withColumn("tie", F.xxhash64("same", "piece"))
    tree = _grow(units, shards)
    placed = units.select("same", "piece", tree.place(lambda leaf: F.lit(leaf.first)).alias("shard"))
    return _with_slots(rows.join(placed, ["same", "piece"]), shards, count)


def _with_pieces(rows: DataFrame, target: float) -> DataFrame:
    """``piece``: 0, or for equal texts of over ``WHOLE_SHARE`` of a shard one of several by row.

    Fewer than shards / WHOLE_SHARE texts can be that large, which bounds what is broadcast.
    """
    limit = WHOLE_SHARE * target
    totals = rows.groupBy("same").agg(F.sum("size").alias("bytes"))
    large = totals.filter(F.col("bytes") > limit).select("same", F.ceil(F.col("bytes") / limit * 2).alias("pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.lit(0).cast("long"))
    return rows.join(F.broadcast(large), "same", "left").withColumn("piece", piece).drop("pieces")


def _grow(units: DataFrame, shards: int) -> Node:
    extent = units.agg(*(f(d) for d in DIMENSIONS for f in (F.min, F.max))).first()
    whole = {d: (extent[2 * i + 1] - extent[2 * i]) or 1.0 for i, d in enumerate(DIMENSIONS)}
    root = Node(0, shards)
    while active := [leaf for leaf in root.leaves() if leaf.count > 1]:
        _choose_dimensions(units, root, active, whole)
        below = dict.fromkeys(range(len(active)), 0)
        # the bin of the median, then the hash bins inside it, coarse and fine
        low_bits = 64 - 2 * HASH_BITS
        coarse, fine = F.shiftrightunsigned("tie", 64 - HASH_BITS), F.shiftrightunsigned("tie", low_bits)
        bins = _crossing(units, root, active, below, lambda leaf: leaf.bins(), lambda leaf: F.lit(True))
        for n, leaf in enumerate(active):
            leaf.bin = bins.get(n, 0)
        parts = _crossing(units, root, active, below, lambda leaf: coarse, lambda leaf: leaf.bins() == leaf.bin)
        for n, leaf in enumerate(active):
            leaf.prefix = parts.get(n, 0)
        exact = _crossing(
            units, root, active, below, lambda leaf: fine,
            lambda leaf: (leaf.bins() == leaf.bin) & (coarse == leaf.prefix), nearest=True,
        )
        for n, leaf in enumerate(active):
            leaf.prefix = exact.get(n, leaf.prefix << HASH_BITS)
            half = (leaf.count + 1) // 2
            leaf.low, leaf.high = Node(leaf.first, half), Node(leaf.first + half, leaf.count - half)
    return root


def _choose_dimensions(units: DataFrame, root: Node, active: list[Node], whole: dict[str, float]) -> None:
    numbers = {id(leaf): n for n, leaf in enumerate(active)}
    node = root.place(lambda leaf: F.lit(numbers.get(id(leaf))))
    stats = units.withColumn("node", node).filter("node is not null").groupBy("node")
    for row in stats.agg(*(f(d) for d in DIMENSIONS for f in (F.min, F.max))).collect():
        leaf = active[row[0]]
        spans = {d: (row[2 * i + 1], row[2 * i + 2] - row[2 * i + 1]) for i, d in enumerate(DIMENSIONS)}
        leaf.dimension = max(DIMENSIONS, key=lambda d: spans[d][1] / whole[d])
        leaf.start, leaf.width = spans[leaf.dimension][0], spans[leaf.dimension][1] or 1.0
    for leaf in active:
        leaf.dimension = leaf.dimension or DIMENSIONS[0]


def _crossing(units, root, active, below, key, only, nearest=False) -> dict[int, int]:
    """For each active node the key at which the weight from below reaches its share; adds the weight under that key
    to ``below``. With ``nearest`` the key may be the next one, if that comes closer."""
    numbers = {id(leaf): n for n, leaf in enumerate(active)}

    def of_leaf(leaf: Node) -> Column:
        if id(leaf) not in numbers:
            return F.lit(None).cast("struct<node:int,key:bigint,inside:boolean>")
        return F.struct(
            F.lit(numbers[id(leaf)]).alias("node"), key(leaf).cast("bigint").alias("key"), only(leaf).alias("inside")
        )

    found = units.select(root.place(of_leaf).alias("at"), "weight").filter("at is not null")
    sums = found.groupBy("at.node", F.when(F.col("at.inside"), F.col("at.key")).alias("key"))
    rows = sums.agg(F.sum("weight").alias("weight")).collect()
    out = {}
    for n, leaf in enumerate(active):
        own = sorted((r["key"], r["weight"]) for r in rows if r["node"] == n and r["key"] is not None)
        if leaf.total is None:
            leaf.total = sum(w for _, w in own)  # the first pass sees the whole node
        goal = leaf.total * ((leaf.count + 1) // 2) / leaf.count
        for k, w in own:
            if below[n] + w >= goal:
                after = nearest and below[n] + w - goal < goal - below[n]
                out[n] = k + 1 if after else k
                break
            below[n] += w
        else:
            if own:
                out[n] = own[-1][0]
                below[n] -= own[-1][1] if not nearest else 0
    return out


def _with_slots(rows: DataFrame, shards: int, count: int) -> DataFrame:
    """Gapless numbers inside each shard: rows are numbered in buckets, and buckets start where those before end."""
    buckets = max(1, min(NUMBERINGS, count // (shards * NUMBERED)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    sums = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = rows.withColumn(
        "place", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")).cast("long")
    )
    # at most shards x NUMBERINGS rows
    joined = numbered.join(F.broadcast(starts), ["shard", "bucket"])
    slot = (F.col("start") + F.col("place") - 1).cast(T.LongType())
    return joined.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))
