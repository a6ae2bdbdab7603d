"""Byte-level vocabularies: reading the public files, and folding ranked merges over the bytes of one word."""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Callable, Mapping

import public_tokenizers

PATTERN = public_tokenizers.PATTERN
#: Bytes of a word up to which the least pair is found by a scan; either way gives the same pieces.
SCANNED = 40
UNRANKED = 1 << 40


class Memo(dict):
    """Results of ``make`` by key, at most ``most`` of them; keys longer than ``longest`` are not kept.

    There are two generations: when the young one is full it becomes the old one, and what is met again moves back. So
    frequent keys stay, and rare ones make room.
    """

    def __init__(self, make: Callable, most: int = 120_000, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, max(1, most // 2), longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def single_spaced(text: str) -> bool:
    """No two white spaces meet, so the pattern never looks across a space that leads a word."""
    return _TWO_SPACES.search(text) is None


_TWO_SPACES = re.compile(r"\s\s")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files: printable Latin-1 stands for itself,
    the other bytes for the code points from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def read_merges(path: str) -> tuple[frozenset[bytes], dict[tuple[bytes, bytes], int], tuple[str, ...]]:
    """Pieces, ranked merges and the special strings of a byte-level ``.json`` file."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    letters = byte_letters()
    special = tuple(t["content"] for t in content["added_tokens"])

    def raw(piece: str) -> bytes:
        return bytes(letters[c] for c in piece)

    model = content["model"]
    pieces = frozenset(raw(p) for p in model["vocab"] if p not in special)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return pieces, {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}, special


class PairRanks(Mapping):
    """Ranks of pairs where a pair merges whenever its concatenation has a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def get(self, pair, default=None):
        return self.ranks.get(pair[0] + pair[1], default)

    def __getitem__(self, pair):
        return self.ranks[pair[0] + pair[1]]

    def __iter__(self):
        return iter(self.ranks)

    def __len__(self):
        return len(self.ranks)


def fold_merges(word: bytes, pair_ranks: Mapping) -> list[bytes]:
    """Pieces of ``word`` after merging, again and again, the leftmost adjacent pair of least rank.

    Short words are scanned for the pair; long ones keep a heap of pairs over a linked list, O(n log n), so that a
    word of a million bytes is no trouble.
    """
    if len(word) <= SCANNED:
        return _fold_by_scan([word[i : i + 1] for i in range(len(word))], pair_ranks)
    return _fold_by_heap([word[i : i + 1] for i in range(len(word))], pair_ranks)


def _fold_by_scan(parts: list[bytes], pair_ranks: Mapping) -> list[bytes]:
    get = pair_ranks.get
    ranks = [get(pair, UNRANKED) for pair in zip(parts, parts[1:])]
    while ranks:
        least = min(ranks)
        if least == UNRANKED:
            break
        i = ranks.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del ranks[i]
        if i < len(ranks):
            ranks[i] = get((parts[i], parts[i + 1]), UNRANKED)
        if i:
            ranks[i - 1] = get((parts[i - 1], parts[i]), UNRANKED)
    return parts


def _fold_by_heap(parts: list[bytes | None], pair_ranks: Mapping) -> list[bytes]:
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap = []
    for i in range(len(parts) - 1):
        rank = pair_ranks.get((parts[i], parts[i + 1]))
        if rank is not None:
            heap.append((rank, i, parts[i], parts[i + 1]))
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if parts[i] is not left or j >= len(parts) or parts[j] is not right:
            continue  # one of the two has been merged meanwhile
        parts[i], parts[j] = left + right, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts):
                found = pair_ranks.get((parts[a], parts[b]))
                if found is not None:
                    heapq.heappush(heap, (found, a, parts[a], parts[b]))
    return [p for p in parts if p is not None]
