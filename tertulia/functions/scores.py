"""Small numeric and verdict expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tertulia.functions.text import strip

# The score of each sentiment label; any other label scores 0.
LABEL_SCORES = {"POS": 1, "NEG": -1, "NEU": 0}


def sentiment_score(label: Column) -> Column:
    known = [F.when(label == name, value) for name, value in LABEL_SCORES.items()]
    return F.coalesce(*known, F.lit(0))


def answer_text(answer: Column) -> Column:
    """The reviewer's answer in the form the keywords are compared with."""
    return F.upper(strip(answer))


def verdict(answer: Column, keywords: Sequence[str]) -> Column:
    """True when any keyword occurs in the upper-cased answer; null for a missing answer."""
    text = answer_text(answer)
    if not keywords:
        return F.when(answer.isNotNull(), F.lit(False))
    return reduce(or_, (text.contains(word) for word in keywords))
