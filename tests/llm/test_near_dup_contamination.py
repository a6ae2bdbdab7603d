"""Near duplicates and benchmark contamination, against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tertulia.llm import decontaminate, near_dup
from tertulia.llm.components import components


def random_text(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = random_text(rng, 1)
    return " ".join(words)


def shingle_set(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_components(rows):
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingle_set(text))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if any(100 * len(a & b) >= 85 * len(a | b) > 0 and a & b for a in sets[i] for b in sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for base in range(12):
        text = random_text(rng, rng.choice((60, 120, 200)))
        out += [changed(rng, text, rng.choice((0, 1, 1, 2, 3, 5))) for _ in range(8)]
    hub = random_text(rng, 150)
    out += [hub] + [changed(rng, hub, 2) for _ in range(40)]  # all near the hub, many not near each other
    shared = random_text(rng, 80)
    out += [shared + " " + random_text(rng, 60) for _ in range(30)]  # one passage in many documents
    out += ["", " \t ", "one two", "ONE two", "one two three four five", "x" * 100_000]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("block", [near_dup.BLOCK, 5])
def test_components_equal_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = near_dup.near_duplicates(df).collect()
    expected = brute_components(rows)
    assert len(got) == len(rows) + 2
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(shingle_set(rows[r.doc_id][1])), expected[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("linked", [80, 85])
def test_near_copies_that_are_not_linked_emit_few_rows(spark, linked, monkeypatch):
    made, hidden = [], near_dup._hidden_links

    def counted(*parts):
        made.append(hidden(*parts).count())
        return hidden(*parts)

    monkeypatch.setattr(near_dup, "_hidden_links", counted)
    rng = random.Random(9)
    base = random_text(rng, 60)
    texts = [(i, changed(rng, base, 1)) for i in range(600)]
    sets = [shingle_set(t) for _, t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if 100 * both >= linked * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    for n in (150, 300, 600):
        got = near_dup.near_duplicates(spark.createDataFrame(texts[:n], "doc_id long, text string"), linked=linked).collect()
        if n == len(texts):
            assert {r.doc_id: r.component_id for r in got} == {i: root(i) for i in range(n)}
    assert all(rows < n for rows, n in zip(made, (150, 300, 600), strict=True))


def test_odd_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (3, None), (4, ""), (5, "a b c"), (2, "A b\tc"), (5, "z " * 50)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got if r.doc_id is not None) == [
        (2, 2, True), (3, 3, True), (4, 4, True), (5, 2, False), (5, 2, False),
    ]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.deduplicated(empty).count() == 0


def test_one_of_each_group_stays(spark, rows):
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").withColumn("lang", F.lit("en"))
    kept = near_dup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(rows).values()))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_few_links_take_few_tasks_however_many_the_session_deals_by(spark, monkeypatch):
    from tertulia.llm import components as module

    rounds, kept = [], module.settle
    monkeypatch.setattr(module, "settle", lambda df: rounds.append(kept(df)) or rounds[-1])
    options = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long")
        assert {r.component for r in components(links).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rounds) > 2 and all(r.rdd.getNumPartitions() <= 4 for r in rounds[1:])


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_hits(text, items):
    doc, hit, found = words(text), set(), set()
    for item, own in items:
        own = words(own)
        for i in range(max(1, len(own) - 12) if own else 0):
            window = own[i : i + 13]
            for k in range(len(doc) - len(window) + 1):
                if doc[k : k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
                    found.add(str(item))
    return len(doc), len(hit), sorted(found)


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_hits_equal_brute_force(spark, part_bytes):
    rng = random.Random(3)
    long_items = [" ".join(rng.choice("abc") for _ in range(rng.randint(13, 25))) for _ in range(12)]
    items = [(i, t) for i, t in enumerate([*long_items, "é-ü, Ñ", "q", "", "...", "one two three", long_items[0]])] + [(0, long_items[0])]
    texts = [" ".join(rng.choice("abc") for _ in range(60)) for _ in range(20)]
    texts += [f"Z {long_items[2].upper()}!! {long_items[2]}, z", "é ü ñ É-Ü ñ", "q-Q q", "", None, "one.two\nthree four", "w " * 30_000 + long_items[1]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").withColumn("hits", F.lit(1))
    bench = spark.createDataFrame(items + [(None, "x")], "item_id long, text string")
    got = decontaminate.with_hits(docs, bench, part_bytes=part_bytes).withColumns(
        {"n": decontaminate.n_hit(F.col("hits")), "c": decontaminate.is_contaminated(F.col("hits"))}
    ).collect()
    for r in got:
        n, hit, found = brute_hits(texts[r.doc_id], items)
        assert (r.hits.n_words, r.n, list(r.hits["items"])) == (n, hit, found)
        assert r.c == (hit > 0 and 20 * hit >= n)
        for w in r.hits.words:
            assert words(texts[r.doc_id][w.start : w["end"]]) == words(texts[r.doc_id])[w.first : w.last + 1]


def test_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.with_hits(docs, none).first().hits.n_words == 2
    assert decontaminate.with_hits(docs.limit(0), none).count() == 0


def test_stage_of_the_pipeline_links_at_80_percent(spark):
    """Pairs of a similarity from 0.80 to 0.85 are near duplicates for the pipeline, and not for op9."""
    rng = random.Random(8)
    rows = []
    for base in range(60):
        words = random_text(rng, 104).split()
        other = list(words)
        other[50:50 + rng.choice((5, 6, 7, 8, 9))] = random_text(rng, 6).split()
        rows += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(other))]
    sets = [shingle_set(text) for _, text in rows]
    near = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    expected = [2 * i for i in range(60)] + [2 * i + 1 for i, s in enumerate(near) if s < 0.8]
    assert any(0.8 <= s < 0.85 for s in near) and any(s < 0.8 for s in near)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.length("text").cast("long")})
    assert sorted(r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs, "").collect()) == sorted(expected)
    apart = [2 * i for i in range(60)] + [2 * i + 1 for i, s in enumerate(near) if s < 0.85]
    assert sorted(r.doc_id for r in near_dup.deduplicated(docs).collect()) == sorted(apart)


@pytest.mark.parametrize("linked", [80, 85, 90])
def test_sketches_lose_no_more_links_than_bands(linked):
    by, share = near_dup.law(linked), linked / 100
    n, equal = by.bands * by.rows, share + (1 - share) / 256
    refused = sum(math.comb(n, k) * equal**k * (1 - equal) ** (n - k) for k in range(by.agreeing))
    assert refused <= (1 - share**by.rows) ** by.bands <= 1e-5


def test_one_part_of_the_benchmark_at_a_time(spark, monkeypatch):
    from pyspark.core.broadcast import Broadcast

    alive, most, read = set(), [], []
    made, dropped, parts = type(spark.sparkContext).broadcast, Broadcast.destroy, decontaminate._parts

    def broadcast(context, value):
        out = made(context, value)
        alive.add(id(out))
        most.append((len(alive), len(read)))
        return out

    def destroy(own, *args, **options):
        alive.discard(id(own))
        return dropped(own, *args, **options)

    def counted(*args):
        for part in parts(*args):
            read.append(part)
            yield part

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", destroy)
    monkeypatch.setattr(decontaminate, "_parts", counted)
    items = [(i, f"item {i} " + "x " * 20) for i in range(4)]
    docs = spark.createDataFrame([(1, "item 2 " + "x " * 20 + "and item 3 " + "x " * 20)], "doc_id long, text string")
    hits = decontaminate.with_hits(docs, spark.createDataFrame(items, "item_id long, text string"), part_bytes=10)
    assert hits.first().hits["items"] == ["0", "1", "2", "3"]
    assert most == [(1, 1), (1, 2), (1, 3), (1, 4)]
