"""Token counts, byte-level BPE: against the public libraries and by round trips."""

import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tertulia.llm import bpe, token_counts
from tertulia.llm.vocabulary import PairRanks, _fold_by_heap, _fold_by_scan, read_ranks

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "  \n\n ", "a", "Hello world, it's 2024!", "they'll we've 've 'v '", "x  y   z\t\n w ", "<|endoftext|>",
    "a.<|endoftext|> b<|endoftext|><|endof", "日本語テスト 👍🏽 ok", "Ünïcödé ñ ç ß", "aaaa" * 500, "!?" * 300, "a\u0301b\u200d",
    "\u0558 \u088f \u2c2f", "mot" * 40 + " " + "0123456789" * 9, "tab\tand\r\nlines\n\n\nend ",
]
MANY = settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
ANY = st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\t'<|>aest19.,"), max_size=60)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(JSON)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def n_tokens(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix_has_its_count(counter, library, text):
    places = range(len(text) + 1) if len(text) < 80 else random.Random(1).sample(range(len(text) + 1), 60)
    counts = counter.counts(text)
    assert len(counts) == len(text) + 1
    assert [counts[k] for k in places] == [n_tokens(library, text[:k]) for k in places]


@MANY
@given(text=ANY)
def test_prefixes_of_any_text(counter, library, text):
    assert counter.counts(text).tolist() == [n_tokens(library, text[:k]) for k in range(len(text) + 1)]


def test_prefix_columns(spark):
    rows = [(1, "Hello world"), (2, None), (2, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("prefix_tokens", F.lit("clash"))
    counted = token_counts.with_prefix_counts(df, JSON)
    out = counted.select(
        "doc_id",
        token_counts.total_tokens(F.col("prefix_tokens")).alias("n"),
        token_counts.tokens_of_prefix(F.col("prefix_tokens"), 5).alias("five"),
        token_counts.longest_prefix(F.col("prefix_tokens"), 1).alias("fits"),
    ).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, 2, 1, 5), (2, 0, 0, 0), (2, 0, 0, 0), (None, 0, 0, 0)], key=str)
    assert token_counts.with_prefix_counts(df.limit(0), JSON).count() == 0


def test_scan_and_heap_fold_alike():
    pairs = PairRanks(read_ranks(RANKS))
    rng = random.Random(2)
    for _ in range(300):
        word = bytes(rng.choice(b"abehtnsr \xc3\xa9") for _ in range(rng.randint(0, 50)))
        parts = [word[i : i + 1] for i in range(len(word))]
        assert _fold_by_scan(list(parts), pairs) == _fold_by_heap(list(parts), pairs)


@MANY
@given(texts=st.lists(ANY, max_size=8))
def test_ids_of_any_texts(reference, texts):
    encoder = bpe._encoder(RANKS, read_ranks(RANKS)) if RANKS not in bpe._encoders else bpe._encoders[RANKS]
    ids, sizes = encoder.encode(texts)
    ends = sizes.cumsum().tolist()
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes.tolist(), strict=True)] == [
        reference.encode_ordinary(t) for t in texts
    ]


def test_round_trip(spark, reference):
    df = spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id long, text string").withColumn("ids", F.lit(0))
    done = bpe.with_decoded(bpe.with_ids(df, RANKS), RANKS).orderBy("doc_id").collect()
    assert [r.ids for r in done] == [reference.encode_ordinary(t or "") for t in [*TEXTS, None]]
    assert [bytes(r.decoded).decode() for r in done] == [*TEXTS, ""]
    assert bpe.with_ids(df.limit(0), RANKS).count() == 0
    none = spark.createDataFrame([(None,)], "ids array<int>")
    assert bpe.with_decoded(none, RANKS).first().decoded is None
