"""Best match against a large catalog: groups of entries that cannot hold the best are left out, exactly.

By the triangle inequality of angles, no entry of a group is nearer to a vector than the group's centre is, less the
group's radius. A vector meets its nearest group first and then only groups whose bound reaches its best so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tertulia.operators.scoring import once
from tertulia.operators.semantic import CATALOG, DIGITS, SIMILARITY_CELLS, SLICE_BYTES, SLICES_PER_PASS, cosines, vectors_of
from tertulia.operators.turns import number_sorted
from tertulia.sources.staging import settle

#: Entries a group holds on the average.
GROUP_ENTRIES = 64
#: Pivots held by a task at most. Catalogs of more than ``GROUP_ENTRIES * MOST_GROUPS`` entries have larger groups.
MOST_GROUPS = 8192
#: Far more than rounding can move an angle or a cosine, so that no group with an equal best is left out.
MARGIN = 1e-6

_FOUND = "struct<level:double,rank:int,similarity:double,compared:long>"


def _parts(rows: np.ndarray, others: int) -> list[np.ndarray]:
    """Rows in parts whose matrix with so many others is of bounded size."""
    step = max(1, SIMILARITY_CELLS // others)
    return [rows[at : at + step] for at in range(0, len(rows), step)]


def _nearest_pivot(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.concatenate([cosines(part, pivots).argmax(axis=1) for part in _parts(vectors, len(pivots))])


def grouped(catalog: DataFrame, entries: int = GROUP_ENTRIES) -> DataFrame:
    """The catalog with ``group_no``, the nearest of every so many entries. Runs jobs.

    The pivots are spread evenly over the ids; which they are changes the work only, never a result.
    """
    base = settle(catalog.select("cat_id", "embedding"))
    count = base.count()
    every = max(entries, -(-count // MOST_GROUPS))
    numbered = number_sorted(base, "cat_id", "_row")
    chosen = numbered.where(F.col("_row") % every == 0).select("cat_id", "embedding").toArrow().sort_by("cat_id")
    shared = catalog.sparkSession.sparkContext.broadcast(vectors_of(chosen["embedding"]) if count else None)

    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.int32())
        return pa.array(_nearest_pivot(vectors_of(vectors), shared.value).astype(np.int32))

    return base.select("*", once(nearest)("embedding").alias("group_no"))


class Groups:
    """Vectors of one slice, sorted by group and id, with centres and radii of the groups."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, numbers: np.ndarray):
        self.ids, self.vectors = ids, vectors
        starts = np.flatnonzero(np.diff(numbers, prepend=-1))
        self.ranges = list(zip(starts, [*starts[1:], len(ids)], strict=True))
        self.centres = np.stack([_unit(vectors[a:b]).sum(axis=0) for a, b in self.ranges])
        least = [cosines(vectors[a:b], c[None]).min() for (a, b), c in zip(self.ranges, self.centres, strict=True)]
        self.radii = np.arccos(np.clip(least, -1, 1))
        # An entry without length has the similarity 0 to everything, whatever the angles.
        bare = ~vectors.any(axis=1)
        self.open = np.array([bare[a:b].any() for a, b in self.ranges]) | ~self.centres.any(axis=1)

    def best(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rounded similarity, id, plain similarity, and the number of entries compared, of each row."""
        found = map(self._best, _parts(rows, len(self.ranges)))
        return tuple(np.concatenate(columns) for columns in zip(*found, strict=True))

    def _best(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        near = cosines(rows, self.centres)
        home = near.argmax(axis=1)
        bounds = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - self.radii, 0)) + MARGIN
        bounds[:, self.open] = 2
        bounds[~rows.any(axis=1)] = 2
        level, plain = np.full(len(rows), -2.0), np.full(len(rows), -2.0)
        found, compared = np.full(len(rows), np.iinfo(np.int32).max), np.zeros(len(rows), np.int64)

        def meet(group: int, some: np.ndarray) -> None:
            a, b = self.ranges[group]
            similar = cosines(rows[some], self.vectors[a:b])
            rounded = similar.round(DIGITS)
            first = rounded.argmax(axis=1)
            at = np.arange(len(some))
            top, ids = rounded[at, first], self.ids[a:b][first]
            better = (top > level[some]) | ((top == level[some]) & (ids < found[some]))
            kept = some[better]
            level[kept], found[kept], plain[kept] = top[better], ids[better], similar[at, first][better]
            compared[some] += b - a

        def meet_all(group: int, some: np.ndarray) -> None:
            a, b = self.ranges[group]
            for part in _parts(some, b - a):
                meet(group, part)

        for group in np.unique(home):
            meet_all(group, np.flatnonzero(home == group))
        for group in np.argsort(-bounds.max(axis=0, initial=-2)):
            some = np.flatnonzero((bounds[:, group] >= level) & (home != group))
            if len(some):
                meet_all(group, some)
        return level, found, plain, compared


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def pruned_match(
    chunks: DataFrame, catalog: DataFrame, entries: int = GROUP_ENTRIES, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """The rows of ``semantic.best_match`` by fewer products, and ``compared``: the catalog entries a chunk met.

    Same best entry, same rule for ties. The catalog is dealt to slices in the order of its groups, so that a slice holds
    near entries; with several slices the chunks are settled first, and again after every ``SLICES_PER_PASS``. A group
    with an entry without length is never left out, and a chunk without length meets everything. Runs jobs.
    """
    base = catalog.select(*CATALOG, "embedding")
    count, width, missing = base.agg(
        F.count("embedding"), F.max(F.size("embedding")), F.count_if(F.col("embedding").isNull())
    ).first()
    if missing:
        raise ValueError(f"{missing} catalog phrases have no embedding")
    none = F.lit(None)
    if not count:
        empty = {"cat_id": "int", "similarity": "double", "compared": "long", "frase": "string", "categoria": "string", "tipo": "string"}
        return chunks.select("*", *(none.cast(kind).alias(name) for name, kind in empty.items()))
    rows = max(1, slice_bytes // (8 * width))
    place = F.struct("group_no", "cat_id").alias("_place")
    ordered = settle(number_sorted(settle(grouped(base, entries)).select("*", place), "_place", "_row").drop("_place"))
    near = (settle(chunks) if count > rows else chunks).withColumn("_near", none.cast(_FOUND))
    for i, start in enumerate(range(0, count, rows), 1):
        part = ordered.where(F.col("_row").between(start, start + rows - 1))
        part = part.select("group_no", "cat_id", "embedding").toArrow()  # bounded by slice_bytes
        part = part.sort_by([("group_no", "ascending"), ("cat_id", "ascending")])
        near = near.withColumn("_near", _better(chunks, part)("embedding", "_near"))
        if i % SLICES_PER_PASS == 0 and start + rows < count:
            near = settle(near)
    found = near.select(
        *chunks.columns,
        (-F.col("_near.rank")).alias("cat_id"),
        F.col("_near.similarity").alias("similarity"),
        F.col("_near.compared").alias("compared"),
    )
    return found.join(catalog.select(*CATALOG), "cat_id", "left")


def _better(chunks: DataFrame, part: pa.Table):
    """The better of the best so far and the best of one slice, with the sum of the entries compared."""
    arrays = part["cat_id"].to_numpy().astype(np.int32), vectors_of(part["embedding"]), part["group_no"].to_numpy()
    shared = chunks.sparkSession.sparkContext.broadcast(arrays)
    groups = []  # made once per task

    @F.arrow_udf(_FOUND)
    def better(vectors: pa.Array, before: pa.Array) -> pa.Array:
        if not groups:
            groups.append(Groups(*shared.value))
        given = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        rows = vectors_of(vectors.drop_null()) if len(given) else None
        level, ids, plain, compared = groups[0].best(rows) if len(given) else (np.empty(0),) * 4
        # Before the first slice nothing has been found; -2 is below every similarity.
        old = {f.name: before.field(i).take(pa.array(given)) for i, f in enumerate(before.type)}
        old_level = old["level"].fill_null(-2.0).to_numpy(zero_copy_only=False)
        old_id = -old["rank"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        old_plain = old["similarity"].fill_null(-2.0).to_numpy(zero_copy_only=False)
        met = old["compared"].fill_null(0).to_numpy(zero_copy_only=False)
        keep = (old_level > level) | ((old_level == level) & (old_id < ids))
        fields = [
            pa.array(np.where(keep, old_level, level), pa.float64()),
            pa.array(-np.where(keep, old_id, ids).astype(np.int32), pa.int32()),
            pa.array(np.where(keep, old_plain, plain), pa.float64()),
            pa.array((met + compared).astype(np.int64), pa.int64()),
        ]
        found = pa.StructArray.from_arrays(fields, names=["level", "rank", "similarity", "compared"])
        spot = np.full(len(vectors), -1)
        spot[given] = np.arange(len(given))
        return found.take(pa.array(spot, pa.int64(), mask=spot < 0))

    return once(better)
