"""The registered queries and the pipeline on the smallest data set."""

from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry_points
import corpus_pipeline
from tertulia.llm import decontaminate, near_dup, quality, secrets, suite
from tertulia.llm.common import table
from tertulia.llm.vocabulary import read_ranks

FOLDER = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="no test data")


def test_all_are_registered():
    numbers = {int(n[2:].split("_")[0]) for n in suite.QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in entry_points.queries()


@pytest.mark.parametrize("name", list(suite.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result, expected = suite.QUERIES[name](spark, str(FOLDER)), con.sql(suite.ORACLES[name])
    order = sorted(result.columns)
    assert order == sorted(expected.columns)
    assert sorted(tuple(r[c] for c in order) for r in result.collect()) == sorted(expected.select(*order).fetchall())


#: Their rows are words and neighbours.
OTHER_ROWS = {"op12_spelling_variants", "op13_nearest_vectors"}


@pytest.mark.parametrize("name", [n for n in suite.QUERIES if n not in suite.ORACLES and n not in OTHER_ROWS])
def test_one_row_per_document(spark, name):
    rows = suite.QUERIES[name](spark, str(FOLDER)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in table(spark, str(FOLDER), "documents").collect())


def test_pipeline(spark):
    """Every stage by its operator's own verdicts, each tested elsewhere against brute force."""
    folder = str(FOLDER)
    docs = table(spark, folder, "documents")
    model = quality.train(docs.select("doc_id", "text"), table(spark, folder, "labels"))
    alive = [r for r in docs.collect() if model.score(r.text) >= quality.ACCEPTED]
    sets = {}
    for r in alive:
        sets[r.doc_id] = set(near_dup.shingles(r.text).tolist())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= corpus_pipeline.NEAR * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    alive = [r for r in alive if root(r.doc_id) == r.doc_id]
    items = [(str(r.item_id), r.text) for r in table(spark, folder, "benchmark").collect()]
    scanner = decontaminate.Scanner(items, decontaminate.WINDOW_WORDS)

    def clean(text):
        found = scanner.scan(text)
        hit = sum(w["last"] - w["first"] + 1 for w in found["words"])
        return not (hit and 20 * hit >= found["n_words"])

    def redacted(text):
        out, at = [], 0
        for start, end in secrets.merged((a, b) for _, a, b in secrets.all_spans(text)):
            out += [text[at:start], corpus_pipeline.SECRET]
            at = end
        return "".join([*out, text[at:]])

    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
    )
    expected = {r.doc_id: encoding.encode_ordinary(redacted(r.text)) for r in alive if clean(r.text)}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == expected and 0 < len(got) < docs.count()
