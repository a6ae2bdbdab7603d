"""Chat formatting and sharding."""

import random
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tertulia.llm import chat, shards

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"
ODD = ["", "\\", "\\\\l", "<", "#", "### a: b</turn>\n", "\\### Assistant: </turn> ok", "\n</turn>\n", "\\h\\l\\c:", "é👍"]


def formatted(spark, rows):
    done = chat.render(chat.final_messages(spark.createDataFrame(rows, EVENTS)))
    out = done.select(
        "conv_id",
        "formatted",
        chat.read_back(F.col("formatted")).alias("turns"),
        chat.masked_texts(F.col("formatted"), F.col("loss")).alias("learnt"),
    )
    return {r.conv_id: ([tuple(t) for t in r.turns], r.learnt) for r in out.collect()}


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 2, 1, "delta", None, "lo"),
        (1, 1, 1, "message", "assistant", "hel"),
        (1, 3, 1, "edit", "assistant", "hey"),
        (1, 4, 1, None, "assistant", "!"),
        (1, 5, 2, "message", "user", "again"),
        (1, 6, 3, "message", "assistant", "dropped"),
        (1, 7, 1, "regenerate", "assistant", "HEY"),
        (1, 8, 2, "message", "user", "more"),
        (None, 0, 0, "delta", "assistant", "alone"),
        (2, None, None, "message", None, None),
    ]
    got = formatted(spark, rows)
    assert got[1] == ([("user", "hi"), ("assistant", "HEY"), ("user", "more")], ["HEY"])
    assert got[None] == ([("assistant", "alone")], ["alone"])
    assert got[2] == ([("", "")], [])


def test_odd_texts_come_back(spark):
    rows = [(7, i, i, "message", "assistant" if i % 2 else ODD[i], text) for i, text in enumerate(ODD)]
    turns, learnt = formatted(spark, rows)[7]
    assert turns == [("assistant" if i % 2 else ODD[i], text) for i, text in enumerate(ODD)]
    assert learnt == [text for i, text in enumerate(ODD) if i % 2 and text]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(st.sampled_from("\\<>#/:\nlhctur n"), max_size=12), min_size=1, max_size=30))
def test_any_texts_come_back(spark, texts):
    rows = [(1, i, i, "message", "assistant", t) for i, t in enumerate(texts)]
    assert formatted(spark, rows)[1][0] == [("assistant", t) for t in texts]


def test_same_turn_twice_and_long_conversations(spark):
    rows = [(1, i // 2, i // 2, "message", "user", f"t{i:05d}") for i in range(3 * chat.BLOCK)]
    turns, _ = formatted(spark, rows + [(2, 0, 0, "message", "user", "x")] * 2)[1]
    assert [t for _, t in turns] == [f"t{i:05d}" for i in range(3 * chat.BLOCK)]


def test_no_events(spark):
    assert formatted(spark, []) == {}


DOCS = "doc_id long, text string, lang string, source string, shard string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], DOCS)


@pytest.mark.parametrize("n", [5, 24, 7])
def test_shards_are_whole_and_even(spark, n):
    rows = [(i, "x" * (i % 97), ("en", "de", None)[i % 3], f"s{i % 5}") for i in range(3000)]
    rows += [(10_000 + i, "same text " * 9, "en", "hot") for i in range(1500)]  # a group larger than a shard
    rows += [(None, None, None, None)] * 3
    got = shards.shard(docs(spark, rows), n).collect()
    assert len(got) == len(rows)
    size = {}
    slots = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(size) == set(range(n))
    assert max(size.values()) - min(size.values()) <= 0.08 * sum(size.values()) / n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        raw = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i % 400} " * 3, "en", f"s{i % 400 % 7}") for i in range(4000)]
    placed = shards.shard(docs(spark, rows), 8)
    assert placed.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_no_documents_and_one(spark):
    assert shards.shard(docs(spark, []), 24).count() == 0
    assert [tuple(r)[1:3] for r in shards.shard(docs(spark, [(1, "a", "en", "s")]), 24).collect()] == [(9, zlib.crc32(b"a"))]


def by_hand(events):
    """Messages of one conversation: events are (message, seq, kind, text)."""
    low = float("-inf")
    alive = [
        e for e in events
        if not any(k == "regenerate" and m <= e[0] and s is not None and s > (low if e[1] is None else e[1]) for m, s, k, _ in events)
    ]
    out, before = [], None
    for message, _, kind, text in sorted(alive, key=lambda e: (e[0], low if e[1] is None else e[1], e[2], e[3])):
        if message != before or kind == "message":
            out.append(text)
        else:
            out[-1] = text if kind in ("edit", "regenerate") else out[-1] + text
        before = message
    return out


@pytest.mark.parametrize("block", [1, 3, 512])
def test_regenerations_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    draw = random.Random(block)
    logs = {conv: [] for conv in (None, 1, 2, 3)}
    for conv, log in logs.items():
        for seq in range(60):
            kind = draw.choice(chat.KINDS) if conv != 3 else draw.choice(["message", "delta"])
            log.append((draw.randint(0, 12), draw.choice([seq, seq, seq, None, 7]), kind, f"{seq};"))
    rows = [(conv, m, s, k, "user", t) for conv, log in logs.items() for m, s, k, t in log]
    events = spark.createDataFrame(rows, "conv_id long, message int, seq int, kind string, role string, text string")
    got = {conv: [] for conv in logs}
    for r in sorted(chat.final_messages(events).collect(), key=lambda r: r.block):
        got[r.conv_id] += [t.text for t in r.turns]
    assert got == {conv: by_hand(log) for conv, log in logs.items()}


def test_a_conversation_regenerated_very_often(spark):
    """Every message was regenerated: no array holds more than the marks of a block."""
    events = spark.range(100_000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("message"), F.col("id").alias("seq"),
        F.lit("regenerate").alias("kind"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"),
    )
    done = chat.final_messages(events).select(F.size("turns").alias("n"), F.element_at("turns", -1)["text"].alias("last"))
    assert done.agg(F.sum("n"), F.max("n"), F.count_if(F.col("last") == "99999")).first() == (100_000, chat.BLOCK, 1)
    last = spark.createDataFrame([(1, 0, 10**6, "regenerate", "user", "all anew")], events.schema)
    assert [[t.text for t in r.turns] for r in chat.final_messages(events.union(last)).collect()] == [["all anew"]]
