"""String expressions used by the parsing, cleaning and rule jobs.

The text semantics are those of Python strings (Unicode classes, Unicode blanks), so the Java patterns
carry explicit flags: ``U`` for Unicode classes and ``d`` so that ``.`` stops at a line feed only.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from itertools import filterfalse

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a blank and what ends a line in a Python string.
BLANK = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# The accented vowels that rule matching folds. Other marks (n with tilde, c cedilla) stay.
ACCENTED_VOWELS = "áàäâéèëêíìïîóòöôúùüû"
PLAIN_VOWELS = "aaaaeeeeiiiioooouuuu"


@lru_cache(maxsize=1)
def blank_characters() -> str:
    return "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def _is_mark(char: str) -> bool:
    return unicodedata.category(char) == "Mn"


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, dict[str, str]]:
    """Characters to map one to one and, after them, the marks to delete, as ``translate`` wants them; and the
    characters whose decomposition has several base letters, but for Hangul syllables, which follow a rule."""
    source, target, deleted, several = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        char = chr(code)
        base = "".join(filterfalse(_is_mark, unicodedata.normalize("NFD", char)))
        if not base:
            deleted.append(char)
        elif base != char and len(base) == 1:
            source.append(char)
            target.append(base)
        elif base != char:
            several[char] = base
    return "".join(source + deleted), "".join(target), several


def _code_point(code: Column) -> Column:
    """The character of a code point below 65,536 and above 2,047: three bytes of UTF-8."""
    low = (0xE0 + F.shiftright(code, 12), 0x80 + F.shiftright(code, 6) % 64, 0x80 + code % 64)
    return F.decode(F.unhex(F.concat(*(F.hex(part) for part in low))), "UTF-8")


def _decompose_hangul(col: Column) -> Column:
    """Syllables as their two or three letters, by the arithmetic of the Unicode standard."""

    def letters(char: Column) -> Column:
        place = F.ascii(char) - 0xAC00  # ``ascii`` is the code point of the first character
        last = place % 28
        parts = F.concat(
            _code_point(0x1100 + F.floor(place / 588).cast("int")),
            _code_point(0x1161 + F.floor(place % 588 / 28).cast("int")),
            F.when(last > 0, _code_point(0x11A7 + last)).otherwise(""),
        )
        return F.when(place.between(0, 11171), parts).otherwise(char)

    return F.array_join(F.transform(F.split(col, ""), letters), "")


def strip(col: Column) -> Column:
    """Remove Unicode blanks at both ends."""
    return F.trim(col, F.lit(blank_characters()))


def squash(col: Column) -> Column:
    """Every run of blanks becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(col, f"(?U){BLANK}+", " "))


def _translate(col: Column, source: str, target: str) -> Column:
    """``translate`` for tables of non-ASCII characters: pure ASCII text skips the lookup of each character."""
    return F.when(col.rlike(r"[^\x00-\x7f]"), F.translate(col, source, target)).otherwise(col)


def normalise_accents(col: Column) -> Column:
    """Drop the marks of accented letters: what remains of the canonical decomposition."""
    source, target, several = _accent_tables()

    def rare(text: Column) -> Column:
        out = text
        for char, base in several.items():
            out = F.replace(out, F.lit(char), F.lit(base))
        return F.when(text.rlike(f"[{''.join(several)}\uac00-\ud7a3]"), _decompose_hangul(out)).otherwise(text)

    # a one-element array binds the mapped text, so that it is computed once
    mapped = F.transform(F.array(F.translate(col, source, target)), rare)
    return F.when(col.rlike(r"[^\x00-\x7f]"), F.element_at(mapped, 1)).otherwise(col)


def fold_vowels(col: Column) -> Column:
    """Lower case with plain vowels, the form rules are matched against."""
    return _translate(F.lower(col), ACCENTED_VOWELS, PLAIN_VOWELS)


def drop_fillers(col: Column, words: Sequence[str]) -> Column:
    """Replace each filler (a regex alternative, no word boundary added) by one space."""
    if not words:
        return col
    return F.regexp_replace(col, "(?iU)(" + "|".join(words) + ")", " ")


def squash_words(col: Column) -> Column:
    """Blanks and punctuation, all that is not a word character, become single spaces; none is left at the ends."""
    return F.trim(F.regexp_replace(col, r"[^\p{L}\p{N}_]+", " "))


def clean_text(
    col: Column,
    fillers: Sequence[str] = (),
    strip_accents: bool = True,
    remove_punctuation: bool = True,
) -> Column:
    out = F.lower(col)
    if strip_accents:
        out = normalise_accents(out)
    out = drop_fillers(out, fillers)
    return squash_words(out) if remove_punctuation else squash(out)


def unify_newlines(col: Column) -> Column:
    """CRLF and CR become LF, as a text-mode read does."""
    return F.regexp_replace(col, r"\r\n?", "\n")


def text_lines(col: Column) -> Column:
    """Array of lines. A final line end does not open another, empty line."""
    unified = F.regexp_replace(col, LINE_BREAK, "\n")
    return F.split(F.regexp_replace(unified, r"\n\z", ""), "\n", -1)


def to_seconds(col: Column) -> Column:
    """Seconds of a ``m:ss`` clock; minutes may exceed 59 and seconds are not range-checked."""
    minutes = F.substring_index(col, ":", 1).try_cast("bigint")
    seconds = F.substring_index(col, ":", -1).try_cast("bigint")
    return (minutes * 60 + seconds).try_cast("int")


def to_clock(col: Column) -> Column:
    """The ``m:ss`` form of a number of seconds."""
    minutes = F.floor(col / 60).cast("string")
    return F.concat(minutes, F.lit(":"), F.lpad((col % 60).cast("string"), 2, "0"))


def regex_to_phrase(col: Column) -> Column:
    """Readable words of a rule pattern: boundary marks and optional groups go, operators become blanks."""
    # The patterns that are removed.
    out = F.replace(col, F.lit(r"\b"), F.lit(""))
    out = F.regexp_replace(out, r"(?d)\(\?:.*?\)", "")
    out = F.regexp_replace(out, r"(?d)\(.*?\?\)", "")
    return F.trim(F.regexp_replace(out, r"(?U)[\\()?|\s\x1c-\x1f]+", " "))


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def is_relevant(col: Column, min_words: int, irrelevant: Sequence[str] = ()) -> Column:
    """Enough words, and not one of the listed phrases."""
    enough = word_count(col) >= min_words
    if not irrelevant:
        return enough
    return enough & ~strip(F.lower(col)).isin(*irrelevant)


def sliding_windows(items: Column, window: int, overlap: int) -> Column:
    """Overlapping windows of an array of sentences, each joined by a space; short tails are kept."""
    if not 0 <= overlap < window:
        raise ValueError("overlap must be at least 0 and smaller than the window")
    step = window - overlap
    starts = F.when(
        F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(step))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i + 1, F.lit(window)), " "))


def split_categories(col: Column) -> Column:
    """Array of the non-empty, stripped names of a comma-separated list."""
    return F.filter(F.transform(F.split(col, ","), strip), lambda name: name != "")
