"""Byte-level BPE: texts to ids and back.

Words are cut by the public pattern. The distinct words of a slice of texts are encoded together: ranked merges are
folded over the matrix of their bytes, all words of one length at a time, with a rank map of fixed size that is
shipped as a value. The ids of a text are those of its words in order. Decoding concatenates the bytes of the pieces.

Defined results: null texts encode as empty; null ids decode to null; an id outside the vocabulary is an error.
Rows are never merged, other columns stay, and a column that has the name of the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tertulia.llm.common import slices
from tertulia.llm.vocabulary import PATTERN, UNRANKED, PairRanks, fold_merges, read_ranks

#: Code points of the texts whose distinct words are encoded together.
SLICE_CHARS = 1_000_000
#: Bytes of the words that are folded as a matrix; longer ones are folded one by one.
MATRIX_BYTES = 32


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pairs, self.words = ranks, PairRanks(ranks), regex.compile(pattern)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        splits = sorted(
            (ranks[piece[:i]] << 32 | ranks[piece[i:]], rank)
            for piece, rank in ranks.items()
            for i in range(1, len(piece))
            if piece[:i] in ranks and piece[i:] in ranks
        )
        self.pair_keys, self.pair_ranks = np.array([*zip(*splits, strict=True)], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank, and so id, of the piece that each pair of ids makes."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], UNRANKED)

    def _fold(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, their final ids) of words of one length, given as a matrix of byte ids. Every round merges
        the leftmost least pair of each row, so the rows that still merge keep one length."""
        rows, ranks = np.arange(len(ids)), self._rank(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1 and len(ids):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(ids)), at]
            merging = least < UNRANKED
            yield rows[~merging], ids[~merging]
            rows, ids, ranks, at, least = (x[merging] for x in (rows, ids, ranks, at, least))
            n, width = ids.shape
            own = np.arange(n)
            ids[own, at] = least
            keep = np.ones((n, width), bool)
            keep[own, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[own, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            for place in (at - 1, at):
                inside = (place >= 0) & (place < width - 2)
                row, col = own[inside], place[inside]
                ranks[row, col] = self._rank(ids[row, col], ids[row, col + 1])
        yield rows, ids

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of ids of each word."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        lengths, done = np.zeros(len(raw), np.int64), []
        for size in np.unique(sizes):
            members = np.flatnonzero(sizes == size)
            if size <= MATRIX_BYTES:
                joined = np.frombuffer(b"".join([raw[m] for m in members.tolist()]), np.uint8)
                found = self._fold(self.bytes[joined].reshape(len(members), size))
            else:
                ids = ([self.ranks[p] for p in fold_merges(raw[m], self.pairs)] for m in members.tolist())
                found = ((np.array([i]), np.array([own])) for i, own in enumerate(ids))
            for rows, ids in found:
                lengths[members[rows]] = ids.shape[1]
                done.append((members[rows], ids))
        starts = np.cumsum(lengths) - lengths
        flat = np.zeros(lengths.sum(), np.int32)
        for rows, ids in done:
            flat[starts[rows][:, None] + np.arange(ids.shape[1])] = ids
        return flat, lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        numbers, cut = Numbers(), []
        for text in texts:
            words = self.words.findall(text)
            cut.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        flat, lengths = self.encode_words(list(numbers))
        starts = np.cumsum(lengths) - lengths
        used = np.concatenate(cut) if cut else np.zeros(0, np.int64)
        own = lengths[used]
        ends = np.cumsum(own)
        ids = flat[np.repeat(starts[used] - ends + own, own) + np.arange(own.sum())]
        sizes = np.array([lengths[c].sum() for c in cut], np.int64)
        return ids, sizes


def _slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= most:
            yield part
            part, size = [], 0
    yield part


_encoders: dict[str, Encoder] = {}


def _encoder(path: str, ranks: dict[bytes, int]) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(ranks)
    return _encoders[path]


def with_ids(df: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``df`` with the ids of each text under the ranks of a ``.tiktoken`` file, special strings as plain text."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(path, ranks.value)
        for batch in slices(batches, 1024):
            found = [encoder.encode(part) for part in _slices([t or "" for t in batch.to_pylist()])]
            ids, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))

    return df.withColumn(name, encode(F.col(text)))


def with_decoded(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the bytes that each array of ids stands for."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = {rank: piece for piece, rank in ranks.value.items()}
        for batch in slices(batches):
            values, offsets = batch.values.to_numpy(), batch.offsets.to_numpy()
            valid = batch.is_valid().to_pylist()
            # one row's ids at a time are Python objects
            yield pa.array(
                [
                    b"".join(map(pieces.__getitem__, values[a:b].tolist())) if ok else None
                    for a, b, ok in zip(offsets, offsets[1:], valid, strict=False)
                ],
                pa.binary(),
            )

    return df.withColumn(name, decode(F.col(ids)))
