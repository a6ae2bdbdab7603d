import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tertulia.functions import prompts, scores
from tertulia.functions import text as T

CHARS = st.characters(max_codepoint=0xFFFF, exclude_categories=["Cs", "Cn", "Co"])
TEXTS = st.lists(st.text(CHARS | st.sampled_from(" \n\t\x1c áÉñçüÖ.,¿?_-9eEhH"), max_size=60), min_size=30, max_size=60)
RARELY = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def evaluate(spark, values, make, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


LETTERS = {
    "Crème brûlée, çà et là": "Creme brulee, ca et la",
    "Ñandú üñî ÅØ": "Nandu uni AØ",  # a stroke is part of the letter, not a mark
    "a\u0301\u0327b": "ab",
    "\ud55c\uae00": "\u1112\u1161\u11ab\u1100\u1173\u11af",  # syllables become their letters
    "\uac00": "\u1100\u1161",
    "\u0b94": "\u0b92\u0bd7",  # two base letters
    "\u212b ﬁ ①": "A ﬁ ①",  # canonical decompositions only
    "plain ascii": "plain ascii",
    "": "",
}


def test_accents(spark):
    assert evaluate(spark, list(LETTERS), T.normalise_accents) == list(LETTERS.values())


@RARELY
@given(values=TEXTS)
def test_no_mark_is_left_and_once_is_enough(spark, values):
    once = evaluate(spark, values, T.normalise_accents)
    assert not [c for text in once for c in text if unicodedata.category(c) == "Mn"]
    assert evaluate(spark, once, T.normalise_accents) == once


CLEAN = {
    "  EH, ¿Qué tal?\n Todo-bien  ": "que tal todo bien",
    "o seaañadir, o_sea": "anadir o_sea",
    "leheme 3.5 €": "l eme 3 5",
    "..\t!!": "",
}


def test_clean_text(spark):
    assert evaluate(spark, list(CLEAN), lambda c: T.clean_text(c, ("eh", "o sea"))) == list(CLEAN.values())


@RARELY
@given(values=TEXTS)
def test_cleaning_keeps_words_alone(spark, values):
    got = evaluate(spark, values, T.clean_text)
    assert all(re.fullmatch(r"(\w+( \w+)*)?", text) for text in got)
    assert evaluate(spark, got, T.clean_text) == got


@RARELY
@given(values=TEXTS)
def test_blank_handling_equals_python(spark, values):
    assert evaluate(spark, values, T.strip) == [v.strip() for v in values]
    assert evaluate(spark, values, T.squash) == [" ".join(v.split()) for v in values]
    assert evaluate(spark, values, T.word_count) == [len(v.split()) for v in values]
    assert evaluate(spark, values, T.text_lines) == [v.splitlines() or [""] for v in values]
    words = evaluate(spark, values, T.squash_words)
    assert words == [" ".join(re.findall(r"\w+", v)) for v in values]


@RARELY
@given(values=TEXTS)
def test_fold_vowels_equals_python(spark, values):
    table = str.maketrans(T.ACCENTED_VOWELS, T.PLAIN_VOWELS)
    assert evaluate(spark, values, T.fold_vowels) == [v.lower().translate(table) for v in values]


def test_cleaning_and_folding_differ(spark):
    words = ["Ñandú çã ÜBER"]
    assert evaluate(spark, words, T.clean_text) == ["nandu ca uber"]
    assert evaluate(spark, words, T.fold_vowels) == ["ñandu çã uber"]


def test_cleaning_switches(spark):
    words = ["  Eh, ¡Qué  tal! "]
    assert evaluate(spark, words, lambda c: T.clean_text(c, ("eh",))) == ["que tal"]
    assert evaluate(spark, words, lambda c: T.clean_text(c, ("eh",), strip_accents=False)) == ["qué tal"]
    assert evaluate(spark, words, lambda c: T.clean_text(c, remove_punctuation=False)) == ["eh, ¡que tal!"]


def test_filler_has_no_word_boundary_and_misses_accents(spark):
    assert evaluate(spark, ["Rehén Así"], lambda c: T.clean_text(c, ("EH", "así"))) == ["r en asi"]


def test_clock(spark):
    clocks = ["0:07", "1:09", "75:00", "2:99", "00:30"]
    assert evaluate(spark, clocks, T.to_seconds) == [7, 69, 4500, 219, 30]
    assert evaluate(spark, [7, 69, 4500], T.to_clock, "v int") == ["0:07", "1:09", "75:00"]


@pytest.mark.parametrize(
    ("pattern", "words"),
    [
        (r"\b(es )?caro\b", "es caro"),
        (r"\bno tengo dinero(s)? (en|con)\b", "no tengo dinero s en con"),
        (r"\b(?:muy) caro\b", "caro"),
        (r"\b¿?(cuánto|vale)\??", "¿ cuánto vale"),
        (r"(ya lo (vimos)?)", ""),
        (r"[aeiou]{2}.*x+", "[aeiou]{2}.*x+"),
        (r"\s+(?:a|b)", "s+"),
    ],
)
def test_regex_to_phrase(spark, pattern, words):
    expected = re.sub(r"\\b", "", pattern)
    for part in (r"\(\?:.*?\)", r"\(.*?\?\)"):
        expected = re.sub(part, "", expected)
    expected = " ".join(re.sub(r"[\\()?|]", " ", expected).split())
    assert evaluate(spark, [pattern], T.regex_to_phrase) == [expected]
    if "ya lo" not in pattern and "(es" not in pattern and "dinero" not in pattern:
        assert expected == words


def test_relevance(spark):
    phrases = ["si claro que si", "Muchas gracias a usted ", "dos palabras", ""]
    got = evaluate(spark, phrases, lambda c: T.is_relevant(c, 3, ("muchas gracias a usted",)))
    assert got == [True, False, False, False]


@RARELY
@given(n=st.integers(0, 12), window=st.integers(1, 5), overlap=st.integers(0, 4))
def test_window_count(spark, n, window, overlap):
    items = F.array(*[F.lit(str(i)) for i in range(n)]).cast("array<string>")
    if overlap >= window:
        with pytest.raises(ValueError):
            T.sliding_windows(items, window, overlap)
        return
    step = window - overlap
    got = spark.range(1).select(T.sliding_windows(items, window, overlap)).first()[0]
    assert got == [" ".join(str(j) for j in range(i, min(i + window, n))) for i in range(0, n, step)]
    assert len(got) == -(-n // step)


def test_categories(spark):
    lists = ["a, b,,", " precio ", ",", None]
    assert evaluate(spark, lists, T.split_categories) == [["a", "b"], ["precio"], [], None]


def test_scores(spark):
    labels = ["POS", "NEG", "NEU", "POSITIVE", None]
    assert evaluate(spark, labels, scores.sentiment_score) == [1, -1, 0, 0, 0]
    answers = [" sí, claro ", "no", None, "posible", "Si"]
    got = evaluate(spark, answers, lambda c: scores.verdict(scores.answer_text(c), ("SI", "SÍ")))
    assert got == [True, False, None, True, True]
    lower = evaluate(spark, ["si"], lambda c: scores.verdict(scores.answer_text(c), ("si",)))
    assert lower == [False]


def test_prompts(spark):
    df = spark.createDataFrame([("¿{phrase}?", None)], "frase_original string, categoria string")
    made = df.select(prompts.objection_prompt("{{x}} {phrase}/{category}/{obj_type}.", df.columns)).first()[0]
    assert made == "{x} ¿{phrase}?//."
    with pytest.raises(ValueError):
        prompts.fill_template("{unknown}", phrase=F.lit(1))
    whole = df.select(prompts.summary_prompt(F.col("frase_original"), "Resume:")).first()[0]
    assert whole == "Resume:\n\n¿{phrase}?"
