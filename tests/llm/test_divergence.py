"""The audit of sources, against exact fractions of a plain count."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
import pytest

from tertulia.llm import divergence

SCHEMA = "text string, lang string, source string, rank int, value string, shard int"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def expected(rows, least_docs, leading):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source, *_ in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}

        def shares(counts):
            total = sum(counts.values()) + 2 * len(kept)
            return {t: 1 + floor(Fraction(10**9 * (n + 2), total)) for t, n in counts.items()}

        def apart(p, q):
            return floor(Fraction((p - q) ** 2, p + q))

        p = {s: shares(c) for s, c in own.items()}
        q = shares({t: sum(c[t] for c in own.values()) for t in kept})
        for s in own:
            found = {
                "pair": [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in own if o != s],
                "term": [(t, apart(p[s][t], q[t])) for t in kept if own[s][t] and p[s][t] > q[t]],
            }
            for part, items in found.items():
                items.sort(key=lambda e: (-e[1], e[0].encode()))
                ranked = [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items, 1)]
                out |= set(ranked if part == "pair" else ranked[:leading])
    return out


def audited(spark, rows, **options):
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return [tuple(r) for r in found.collect()]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.RandomState(3)
    words = ["Alpha", "beta", "GAMMA", "déjà", "Été", "中文", "x", "y", "\U0001f600", "İ"]
    out = []
    for k in range(90):
        text = " ".join(rng.choice(words, rng.randint(0, 12)))
        out.append((text, ["en", "de", None, ""][k % 4], [None, "a", "b", "é", "\U0001f600"][k % 5], 1, "v", 2))
    out += [out[0]] * 40  # one document in copies
    out += [(None, "en", "silent", None, None, None), ("", "fr", "only", 0, "", 0), ("1 2 _ !", "fr", "other", 0, "", 0)]
    return out


@pytest.mark.parametrize("least", [1, 4, 10])
def test_equals_plain_counts(spark, rows, least):
    found = audited(spark, rows, least_docs=least, leading=3)
    assert len(found) == len(set(found)) and set(found) == expected(rows, least, 3)


def test_slices_and_shards_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 4)
    terms = [(" ".join(f"{a}{b}" for b in "abcdefgh"), "en", s, 0, "", 0) for a in "ijklmnop" for s in "uvw"]
    assert set(audited(spark, rows + terms, least_docs=2)) == expected(rows + terms, 2, 10)


def test_small_slices_and_full_tables_give_the_same_counts(rows, monkeypatch):
    batch = pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(("text", "lang", "source"))})

    def counted():
        total = Counter()
        for part in divergence.partial_counts(iter([batch, batch.slice(0, 0)])):
            for r in part.to_pylist():
                total[r["lang"], r["source"], r["term"]] += r["n"] * 1000 + r["docs"]
        return total

    whole = counted()
    monkeypatch.setattr(divergence, "SLICE", 40)
    monkeypatch.setattr(divergence, "HELD", 10)
    assert counted() == whole


def test_a_very_long_text(spark):
    rows = [("tail " * 200_000 + "head", "en", s, 0, "", 0) for s in "ab"]
    assert set(audited(spark, rows, least_docs=1)) == expected(rows, 1, 10)


def test_empty_table(spark):
    assert audited(spark, []) == []


def test_shares_are_exact_for_large_counts():
    counts = np.array([10**15, 3, 0], np.int64)
    total = 9 * 10**15 + 7
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]
