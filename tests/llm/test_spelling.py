"""Spelling variants, against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from tertulia.llm import spelling


def counts(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(words):
    near = {w: [x for x in words if x != w and one_edit(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def variants(spark, words):
    found = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return [tuple(r) for r in found.collect()]


@pytest.mark.parametrize("alphabet", ["ab", "abcdé"])
def test_equals_all_pairs(spark, alphabet):
    rng = random.Random(len(alphabet))
    words = {}
    for _ in range(500):
        base = "".join(rng.choice(alphabet) for _ in range(rng.choice((1, 2, 5, 6, 7, 9, 12, 40))))
        words[base] = rng.choice((3, 3, 6, 9, 50, 1000))
        at = rng.randrange(len(base))
        words[base[:at] + rng.choice(["", "a", "bb"]) + base[at + 1 :] or "a"] = rng.choice((3, 3, 4, 7))
    found = variants(spark, words)
    assert len(found) == len(words) and set(found) == expected(words)


def test_edits_at_the_ends_and_in_runs_of_one_letter(spark):
    words = {"aaaaa": 3, "aaaaaa": 7, "aaaaaaa": 20, "baaaaa": 5, "aaaaab": 4, "aabaa": 9, "caaaaaa": 900}
    assert set(variants(spark, words)) == expected(words)


def test_a_tile_of_thousands_over_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        letters = [chr(c) for c in [*range(97, 123), *range(0xE0, 0xF7)]]
        words = {f"stem{a}{b}end": 3 + 5 * (a == b) for a in letters[:30] for b in letters[:20]}
        assert set(variants(spark, words)) == expected(words)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_very_long_words(spark):
    long = "ab" * 3000
    words = {long: 9, long[:2999] + "x" + long[2999:]: 4, long[:-1]: 3, "x" + long[1:]: 3, "short": 5, "shorts": 2}
    assert set(variants(spark, words)) == expected(words)


def test_word_counts(spark):
    rng = random.Random(1)
    pool = ["Words", "words", "Étés", "étés-vou", "naïve", "tiny", "Straße", "aıbcdef", "m×nopq"]
    rows = [(k % 40, " ".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for k in range(300)]
    rows += [(None, "lonely lonely lonely"), (7, None), (8, ""), (9, "z" * 70_000), (9, "z" * 70_000), (9, "z" * 70_000)]
    docs = spark.createDataFrame([(*r, "w", 5) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    found = [tuple(r) for r in spelling.word_counts(docs).collect()]
    assert len(found) == len(dict(found)) and dict(found) == counts(rows)


def test_what_a_run_becomes_loses_nothing_more():
    """A result that equals a run of the text which loses a code point itself."""
    lost = [run for k in range(2, 1200) if zlib.crc32(b"5:" + (run := "a" * k).encode()) % 7 == 0]
    pairs = [(a, a + "a") for a in lost if a + "a" in lost]
    assert pairs
    for short, long in pairs:
        for text in (f"{long} {short}", f"{short} {long}", f"{long} {short} {long}"):
            found = spelling.words_of(5, text, spelling._runs(1), 7)
            assert found == {short[1:]: text.split().count(short), short: text.split().count(long)}


def test_counts_leave_a_full_task(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spelling, "HELD", 2)
    texts = ["alpha beta5 gamma delta", "alpha delta omega", None, "sigma alpha"]
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "text": texts})
    total = Counter()
    for part in spelling._counting(5, 97)(iter([batch])):
        total.update(dict(zip(*(c.to_pylist() for c in part.columns), strict=True)))
    assert total == {"alpha": 3, "gamma": 1, "delta": 2, "omega": 1, "sigma": 1}


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k:02d}", f"w{k + 1:02d}") for k in range(37)]
    found = spelling.roots(spark.createDataFrame(chain, "word string, form string"))
    assert {tuple(r) for r in found.collect()} == {(w, "w37") for w, _ in chain}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(none)).collect() == []
