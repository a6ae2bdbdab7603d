"""Corpus figures of a growing folder, against the figures of one run over all of it."""

import os

import pytest
from pyspark.sql import functions as F

from tertulia.config import RuleSet
from tertulia.operators import dashboard, semantic
from tertulia.plans import objections
from tertulia.sources.transcripts import read_transcripts, with_rejects
from tertulia.streaming import folders, totals

RULES = RuleSet({"MOMENT": {"later": ["luego"]}, "USE": {"none": ["no necesito"], "other": ["otro"]}}, {"later": 2, "other": 3})
SAID = ["luego", "no necesito nada", "otro día", "hola", "luego, tengo otro", "otro, no necesito"]


def scored(calls):
    turns = calls.select("archivo", F.explode(F.split("raw", "\n")).alias("chunk"))
    return turns.withColumn("similarity", F.when(F.length("chunk") % 5 != 4, F.length("chunk") / 40))


def final(calls):
    found = objections.list_objections(calls, RULES)
    return found.select(F.concat_ws(" ,", "type", F.lit(""), "category").alias("categoria"))


WANTED = {"corpus": totals.corpus(RULES), "categories": totals.categories(final), "runs": totals.runs(scored, 0.5)}


def write_calls(folder, numbers):
    for k in numbers:
        turns = [f"Speaker {1 + (i + k) % 2}: {{ 0:{i:02d} }}\n{SAID[(k * 7 + i * i) % len(SAID)]}\n" for i in range(k % 5)]
        (folder / f"{k:03d}.txt").write_text("\n".join(turns))


def figures(spark, path):
    return {n: sorted(map(str, totals.figures(spark, t, path, n).collect())) for n, t in WANTED.items()}


@pytest.fixture
def grown(spark, tmp_path):
    """Three batches, one of rejects alone among them; the function runs what is new."""
    source = tmp_path / "in"
    source.mkdir()

    def run():
        stream = folders.stream_transcripts(spark, str(source), seen=str(tmp_path / "seen"))
        totals.follow(stream, WANTED, str(tmp_path / "totals"), str(tmp_path / "state")).awaitTermination()
        return figures(spark, str(tmp_path / "totals"))

    write_calls(source, range(20, 30))
    run()
    (source / "bad.txt").write_bytes(b"\xff")
    run()
    write_calls(source, [*range(20), *range(30, 45)])
    return source, run


def test_batches_add_up_to_one_run(spark, grown):
    source, run = grown
    found = run()
    good, rejects = with_rejects(read_transcripts(spark, str(source)))
    counts = semantic.run_counts(scored(good), 0.5).agg(*(F.sum(c).alias(c) for c in ("chunks", "detected", "failed", "discarded")))
    assert rejects.count() == 1
    assert found == {
        "corpus": [str(objections.analyse_corpus(good, RULES).first())],
        "categories": sorted(map(str, dashboard.category_distribution(final(good)).collect())),
        "runs": [str(counts.first())],
    }


def test_a_repeated_batch_changes_nothing(spark, grown, tmp_path):
    _, run = grown
    found = run()
    commits = tmp_path / "state" / "commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)  # as if the batch had been lost after its writes
    assert run() == found and run() == found
    assert max(int(n) for n in os.listdir(commits) if n.isdigit()) == last


def test_a_folder_without_calls(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bad.txt").write_bytes(b"\xff")
    stream = folders.stream_transcripts(spark, str(tmp_path / "in"), seen=str(tmp_path / "seen"))
    totals.follow(stream, WANTED, str(tmp_path / "totals"), str(tmp_path / "state")).awaitTermination()
    none = figures(spark, str(tmp_path / "totals"))
    assert none["categories"] == [] and "total_files=0" in none["corpus"][0] and "chunks=0" in none["runs"][0]
