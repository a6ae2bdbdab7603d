"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

A byte-pair encoding of a prefix ends in exactly one piece that can stand after the encoding of what lies before it.
So the count of a prefix is the count of the prefix before that last piece, plus one, and one pass over a word gives
the counts of all its prefixes. The counts answer how many tokens a truncated text has, and how long a text may be
for a budget, without encoding anything again.

Defined results: a null text counts as empty; an empty text has the single prefix count 0. Rows are never merged:
repeated rows repeat their result, other columns stay as they are, and a column that has the name of the result
is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia.llm.common import slices
from tertulia.llm.vocabulary import PATTERN, Memo, fold_merges, read_merges

#: Words, and beginnings of words, that a worker remembers: about 130 MB.
MEMO, STEMS = 600_000, 200_000
#: Texts within this range are cut into words here; the character tables of newer alphabets differ between
#: libraries, so other texts are cut by the tokenizer's own library.
_LAST = 0x4FF
_BEYOND = re.compile(f"[^\\x00-{chr(_LAST)}]")
_RUN_BEFORE_WORD = regex.compile(r"\s{2,}(?=\S)")
#: Contractions that the pattern takes whole, but whose beginnings it cuts after the apostrophe.
_SPLIT_WHEN_CUT = frozenset({"'re", "'ve", "'ll"})


def _own_classes() -> re.Pattern:
    """The pattern for texts within the range, its properties spelled out, for the faster library that knows none."""

    def those(prop: str) -> str:
        found = [c for c in range(_LAST + 1) if regex.fullmatch(prop, chr(c))]
        starts = [c for c, before in zip(found, [-2, *found], strict=False) if c != before + 1]
        ends = [c for c, after in zip(found, [*found[1:], -2], strict=True) if c != after - 1]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))

    pattern = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[{those(r'[^\s\p{L}\p{N}]')}]").replace(r"\S", f"[^{those(r'\s')}]")
    for prop in (r"\p{L}", r"\p{N}", r"\s"):
        pattern = pattern.replace(prop, f"[{those(prop)}]")
    return re.compile(pattern)


class PrefixCounter:
    """Counts the tokens of all prefixes of a text."""

    def __init__(self, path: str):
        self.pieces, self.pair_ranks, self.special = read_merges(path)
        self.longest = max(map(len, self.pieces))
        self.words = _own_classes()
        self.fit = Memo(lambda pair: fold_merges(pair[0] + pair[1], self.pair_ranks) == [*pair], 400_000)
        self.stems = Memo(self._states, STEMS)
        self.word = Memo(self._word, MEMO)
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        from tokenizers import pre_tokenizers

        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def word_counts(self, word: bytes) -> list[int]:
        """Token count of every byte prefix of one word, the empty one included."""
        return self._states(word)[0]

    def _states(self, word: bytes) -> tuple[list[int], list[bytes]]:
        """Token count and last piece of every byte prefix; beginnings that words share are looked up."""
        known = min((len(word) - 1) // 4 * 4, 12)
        counts, last = map(list, self.stems[word[:known]]) if known > 0 else ([0], [b""])
        pieces, fit = self.pieces, self.fit
        for end in range(len(counts), len(word) + 1):
            for start in range(end - 1, max(0, end - self.longest) - 1, -1):  # exactly one piece fits; most are short
                piece = word[start:end]
                if piece in pieces and (start == 0 or fit[last[start], piece]):
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    break
            else:
                raise ValueError(f"the vocabulary cannot encode {word[:end]!r}")
        return counts, last

    def _word(self, word: str) -> bytes:
        """Counts at the ends of the code points of a word, as packed 32-bit numbers."""
        raw = word.encode()
        counts = self.word_counts(raw)[1:]
        if len(raw) != len(word):
            counts = [c for c, following in zip(counts, raw[1:] + b"a", strict=True) if following & 0xC0 != 0x80]
        if word in _SPLIT_WHEN_CUT:
            counts[1] = 2
        return array("i", counts).tobytes()

    def _plain(self, text: str) -> np.ndarray:
        counts = np.zeros(len(text) + 1, np.int32)
        if not text:
            return counts
        if _BEYOND.search(text):
            units = [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        else:
            units = self.words.findall(text)
        packed = map(self.word.__getitem__, units)
        inside = np.frombuffer(b"".join(packed), np.int32)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        totals = inside[np.cumsum(lengths) - 1].astype(np.int64)
        counts[1:] = inside + np.repeat(np.cumsum(totals) - totals, lengths)
        for run in _RUN_BEFORE_WORD.finditer(text):
            start, end = run.span()  # a prefix that ends with the run keeps it as one word
            whole = np.frombuffer(self.word[text[start:end]], np.int32)
            counts[end] = counts[start] + whole[-1]
        return counts

    def counts(self, text: str) -> np.ndarray:
        """Token count of ``text[:k]`` for every k from 0 to its length."""
        found = list(self.split_special.finditer(text)) if self.split_special else []
        if not found:
            return self._plain(text)
        parts, start, base = [], 0, 0
        for match in found:
            inside = self._plain(text[start : match.end() - 1])  # until its last letter, a special string is plain text
            parts.append(inside + base)
            base, start = base + int(inside[match.start() - start]) + 1, match.end()
        parts.append(self._plain(text[start:]) + base)
        return np.concatenate(parts)


@lru_cache(maxsize=1)
def _counter(path: str) -> PrefixCounter:
    """One for each worker process, so that tasks share what they have learnt."""
    return PrefixCounter(path)


def with_prefix_counts(df: DataFrame, path: str, text: str = "text", name: str = "prefix_tokens") -> DataFrame:
    """``df`` with an array: element k + 1 is the token count of the first k code points of the text.

    ``path`` names a byte-level ``.json`` vocabulary that every executor has.
    """

    @F.arrow_udf("array<int>")
    def prefix_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(path)
        for batch in slices(batches):
            arrays = [counter.counts(t or "") for t in batch.to_pylist()]
            offsets = np.zeros(len(arrays) + 1, np.int32)
            np.cumsum([len(a) for a in arrays], out=offsets[1:])
            values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    return df.withColumn(name, prefix_counts(F.col(text)))


def tokens_of_prefix(counts: Column, chars: Column | int) -> Column:
    """Tokens of a text cut after ``chars`` code points."""
    at = F.lit(chars) if isinstance(chars, int) else chars
    return F.element_at(counts, F.least(at, F.size(counts) - 1).cast("int") + 1)


def total_tokens(counts: Column) -> Column:
    return F.element_at(counts, -1).cast("long")


def longest_prefix(counts: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix whose encoding has at most ``budget`` tokens."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    fitting = F.transform(counts, lambda c, k: F.when(c <= limit, k))
    return F.array_max(fitting)
