"""Answers that outlive a job, and tables that readers see whole."""

import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tertulia.operators import scoring
from tertulia.sources import published
from tertulia.sources.answers import AnswerStore

TABLE = "id long, word string"


@pytest.fixture
def reviewer(tmp_path):
    """A reviewer that notes each question; while the folder has a file ``down``, some questions end the task."""

    def complete(prompt):
        number = int(prompt.split()[1])
        if number == 17 and (tmp_path / "down").exists():
            raise SystemExit("machine lost")
        (tmp_path / f"{number}-{uuid.uuid4().hex}.asked").write_text("")
        if number % 10 == 3:
            raise ValueError("odd question")
        return None if number % 10 == 4 else f" yes {number} "

    complete.asked = lambda: Counter(int(file.name.split("-")[0]) for file in tmp_path.glob("*.asked"))
    complete.fail = lambda: (tmp_path / "down").write_text("")
    complete.mend = lambda: (tmp_path / "down").unlink()
    return complete


def questions(spark, start, end):
    prompts = spark.range(start, end).select(F.concat(F.lit("question "), "id").alias("prompt"))
    return prompts.union(prompts).withColumn("prompt_key", F.sha2("prompt", 256))


def test_a_job_stopped_half_way_asks_only_the_rest(spark, tmp_path, reviewer, monkeypatch):
    monkeypatch.setattr(scoring, "TASK_PROMPTS", 2)
    store = AnswerStore(spark, str(tmp_path / "answers"))
    reviewer.fail()
    with pytest.raises(Exception):
        scoring.answer_prompts(questions(spark, 0, 60), reviewer, workers=1, store=store)
    kept = {int(r.answer.split()[1]) for r in store.attempts().where("answer is not null").collect()}
    before = reviewer.asked()
    assert kept and 17 not in kept
    reviewer.mend()
    answers = scoring.answer_prompts(questions(spark, 0, 60), reviewer, workers=1, store=store).collect()
    assert len(answers) == 60 and all(reviewer.asked()[n] == before[n] == 1 for n in kept)
    failed = [r for r in answers if r.error]
    assert len(failed) == 6 and {r.error for r in failed} == {"ValueError: odd question"}
    assert sum(r.answer is None for r in answers) == 12


def test_known_answers_are_final_and_errors_are_asked_again(spark, tmp_path, reviewer):
    store = AnswerStore(spark, str(tmp_path / "answers"))
    first = {r.prompt_key: r for r in scoring.answer_prompts(questions(spark, 0, 20), reviewer, store=store).collect()}
    second = {r.prompt_key: r for r in scoring.answer_prompts(questions(spark, 10, 30), reviewer, store=store).collect()}
    assert len(first) == len(second) == 20
    assert reviewer.asked() == Counter(dict.fromkeys(range(30), 1)) + Counter([13])
    both = set(first) & set(second)
    assert len(both) == 10 and all(first[k].answer == second[k].answer for k in both)
    assert {first[k].run == second[k].run for k in both if first[k].error is None} == {True}
    assert {first[k].run == second[k].run for k in both if first[k].error} == {False}


def test_nothing_to_ask(spark, tmp_path, reviewer):
    store = AnswerStore(spark, str(tmp_path / "answers"))
    none = questions(spark, 0, 2).withColumn("prompt", F.lit(None).cast("string"))
    for asked in (questions(spark, 0, 0), none):
        assert scoring.answer_prompts(asked, reviewer, store=store).count() == 0
    assert not reviewer.asked()


def test_overlapping_runs_keep_the_first_answer(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path / "answers"))
    for answer, error in (("one", None), ("two", None), (None, "late")):
        store.add(spark.createDataFrame([("k", answer, error), ("e", None, f"error {answer}")], "prompt_key string, answer string, error string"))
    keys = spark.createDataFrame([("k",), ("k",), ("e",), ("x",)], "prompt_key string")
    got = {r.prompt_key: (r.answer, r.error) for r in store.answers_to(keys).collect()}
    assert got == {"k": ("one", None), "e": (None, "error None")}


def test_summaries_with_a_store(spark, calls, tmp_path, reviewer):
    store = AnswerStore(spark, str(tmp_path / "answers"))
    texts = calls(a="x 1", b="x 1", c="x 3", d="x 4").withColumn("raw", F.regexp_extract("raw", "[0-9]", 0))
    texts = texts.unionByName(spark.createDataFrame([("e", None)], texts.schema))
    for _ in range(2):
        told, silent = scoring.summarise(texts, lambda p: reviewer("q " + p[-1]), "question", store=store)
        assert {r.archivo: r.resumen for r in told.collect()} == {"a": "yes 1", "b": "yes 1"}
        assert {r.archivo: r.error for r in silent.collect()} == {"c": "ValueError: odd question", "d": None, "e": None}
    assert reviewer.asked() == Counter({1: 1, 3: 2, 4: 1})


def rows(spark, place):
    return sorted(tuple(r) for r in published.read_published(spark, place, TABLE).collect())


def test_readers_see_the_old_table_or_the_new_one(spark, tmp_path):
    place = str(tmp_path / "place")
    assert rows(spark, place) == []
    old = spark.createDataFrame([(1, "a"), (2, None)], TABLE)
    assert published.publish(old, place)
    held = published.read_published(spark, place, TABLE)
    broken = spark.range(0, 8, 1, 4).select("id", F.when(F.col("id") < 7, "x").otherwise(F.raise_error(F.lit("lost"))).alias("word"))
    for append in (False, True):
        with pytest.raises(Exception):
            published.publish(broken, place, append=append)
        assert rows(spark, place) == [(1, "a"), (2, None)]
    assert len(list((tmp_path / "place" / "data").iterdir())) == 3
    assert published.publish(spark.createDataFrame([(9, "z")], TABLE), place)
    assert rows(spark, place) == [(9, "z")] and held.count() == 2


def test_a_repeated_run_changes_nothing(spark, tmp_path):
    place = str(tmp_path / "place")
    part = spark.createDataFrame([(1, "a")], TABLE)
    assert [published.publish(part, place, run="monday", append=True) for _ in range(3)] == [True, False, False]
    assert [published.publish(part, place, append=True) for _ in range(2)] == [True, True]
    assert rows(spark, place) == [(1, "a")] * 3
    assert published.publish(part.limit(0), place, run="empty") and rows(spark, place) == []


def test_publications_at_the_same_time(spark, tmp_path):
    """Entries of jobs that did not know of each other: replacements do not mix, additions all count, a run counts once."""
    place = str(tmp_path / "place")

    def entry(version, folder, run, replaces):
        spark.createDataFrame([(len(folder), folder)], TABLE).write.parquet(f"{place}/data/{folder}")
        spark.createDataFrame([(version, folder, run, replaces)], published.ENTRY).write.json(f"{place}/log/{folder}")

    entry(1, "base", None, True)
    entry(2, "old", None, True)
    entry(2, "new", None, True)
    assert rows(spark, place) == [(3, "old")]
    entry(3, "more", None, False)
    entry(3, "twin", "r", False)
    entry(3, "twin2", "r", False)
    assert rows(spark, place) == [(3, "old"), (4, "more"), (4, "twin")]


def test_other_formats(spark, tmp_path):
    place = str(tmp_path / "place")
    odd = spark.createDataFrame([(1, 'a;"b"\nc')], TABLE)
    options = {"sep": ";", "multiLine": "true", "escape": '"'}
    published.publish(odd, place, fmt="csv", **options)
    assert published.read_published(spark, place, TABLE, "csv", **options).collect() == odd.collect()
