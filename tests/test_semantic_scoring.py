import numpy as np
import pytest
from pyspark.sql import functions as F

from tertulia.config import ChunkOptions, CleanOptions, RuleSet
from tertulia.operators import scoring, semantic
from tertulia.plans import calls as call_plans
from tertulia.plans import detection
from tertulia.sources.transcripts import with_rejects

CATALOG = "cat_id int, frase string, categoria string, tipo string, embedding array<float>"
CHUNKS = "archivo string, turn_no int, chunk_no int, chunk string, embedding array<float>"


def brute_force(vectors, base):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    return unit(np.array(vectors, float)) @ unit(np.array(base, float)).T


@pytest.fixture
def data(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(17, 6)).round(2)
    base[9] = base[4]
    base[16] = 0
    vectors = rng.normal(size=(60, 6)).round(2)
    vectors[7], vectors[8], vectors[9] = base[4], 2 * base[9], 0
    catalog = spark.createDataFrame(
        [(i, f"p{i}", f"c{i % 3}", f"t{i}", [float(x) for x in v]) for i, v in enumerate(base)], CATALOG
    )
    chunks = spark.createDataFrame(
        [("hot" if i < 50 else None, i, i % 2, f"chunk {i}", [float(x) for x in v]) for i, v in enumerate(vectors)]
        + [("none", 0, 0, "no vector", None)],
        CHUNKS,
    )
    return chunks, catalog, brute_force(vectors, base)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 4 * 8 * 6, 8 * 6])
def test_best_match(data, slice_bytes):
    chunks, catalog, similarity = data
    got = semantic.best_match(chunks, catalog, slice_bytes=slice_bytes).collect()
    assert len(got) == 61
    for r in got:
        if r.archivo == "none":
            assert r.cat_id is None and r.similarity is None
            continue
        row = similarity[r.turn_no].round(12)
        assert r.cat_id == int(np.argmax(row))
        assert r.similarity == pytest.approx(row.max(), abs=1e-6)
        assert (r.frase, r.tipo, r.chunk) == (f"p{r.cat_id}", f"t{r.cat_id}", f"chunk {r.turn_no}")
    assert {r.cat_id for r in got if r.turn_no in (7, 8) and r.archivo == "hot"} == {4}


@pytest.mark.parametrize("slice_bytes", [1 << 20, 16])
def test_near_ties_have_one_rule(spark, slice_bytes):
    close = [[1.0, 1e-6 * k] for k in (4, 2, 1, 3)]
    catalog = spark.createDataFrame(
        [(i, f"p{i}", "c", "t", v) for i, v in enumerate(close)],
        "cat_id int, frase string, categoria string, tipo string, embedding array<double>",
    )
    chunks = spark.createDataFrame([("a", 0, 0, "x", [1.0, 0.0])], CHUNKS)
    assert semantic.best_match(chunks, catalog, slice_bytes=slice_bytes).first().cat_id == 2


def test_chunks_are_encoded_once_with_many_slices(spark, tmp_path):
    log = tmp_path / "encoded"
    log.mkdir()

    def make_encoder():
        def encode(texts):
            import uuid

            (log / str(uuid.uuid4())).write_text(str(len(texts)))
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    catalog = spark.createDataFrame(
        [(i, f"p{i}", "c", "t", [float(i), 1.0]) for i in range(12)], CATALOG
    )
    chunks = spark.createDataFrame([("a", i, 0, "x" * i) for i in range(20)], "archivo string, turn_no int, chunk_no int, chunk string")
    encoded = semantic.encode_column(chunks, "chunk", make_encoder)
    scored = semantic.best_match(encoded, catalog, slice_bytes=16)
    assert scored.count() == 20 and scored.where("cat_id is null").count() == 0
    assert sum(int(f.read_text()) for f in log.iterdir()) == 20


def test_catalog_without_an_embedding_is_an_error(data):
    chunks, catalog, _ = data
    with pytest.raises(ValueError):
        semantic.best_match(chunks, catalog.withColumn("embedding", F.when(F.col("cat_id") != 3, F.col("embedding"))))


def test_similarity_matrix_is_bounded(monkeypatch, data):
    monkeypatch.setattr(semantic, "SIMILARITY_CELLS", 40)
    rows = np.random.default_rng(1).normal(size=(23, 4))
    base = np.random.default_rng(2).normal(size=(11, 4))
    top, first = semantic._best(rows, base)
    expected = brute_force(rows, base)
    assert (first == expected.argmax(axis=1)).all() and np.allclose(top, expected.max(axis=1))


def test_whole_numbers_reach_the_threshold_exactly():
    top, _ = semantic._best(np.array([[2.0, 1.0, 0.0]]), np.array([[2.0, 0.0, 1.0]]))
    assert top[0] == 0.8


def test_empty_catalog(data):
    chunks, catalog, _ = data
    scored = semantic.best_match(chunks, catalog.where("false"))
    assert scored.count() == 61
    assert semantic.detections(scored, 0.0).count() == 0


def test_broadcast_form_moves_no_chunks(data):
    chunks, catalog, _ = data
    plan = semantic.best_match(chunks, catalog)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "hashpartitioning" not in plan


def test_models_run_once_per_row(spark, make_encoder):
    columns = "cat_id int, frase string, categoria string, tipo string"
    phrases = spark.createDataFrame([(0, "luego", "MOMENT", "later")], columns)
    catalog = semantic.encode_column(phrases, "frase", make_encoder)
    columns = "archivo string, turn_no int, chunk_no int, chunk string"
    chunks = spark.createDataFrame([("a", 0, 0, "hasta luego")], columns)
    encoded = semantic.encode_column(chunks, "chunk", make_encoder)
    found = semantic.detections(semantic.best_match(encoded, catalog), 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and found.count() == 1


def test_threshold_is_inclusive_and_unrounded(spark):
    scored = spark.createDataFrame(
        [("a", 0, 0, "x", "f", "c", "t", 0.5), ("a", 1, 0, "y", "f", "c", "t", 0.4999), ("a", 2, 0, "z", "f", "c", "t", 0.50049)],
        "archivo string, turn_no int, chunk_no int, chunk string, frase string, categoria string, tipo string, similarity double",
    )
    got = semantic.ordered(semantic.detections(scored, 0.5)).collect()
    assert [(r.frase_original, r.similitud) for r in got] == [("x", 0.5), ("z", 0.5)]
    counts = semantic.run_counts(scored, 0.5).first()
    assert (counts.chunks, counts.detected, counts.failed, counts.discarded) == (3, 2, 0, 1)
    both = semantic.union_detections(semantic.detections(scored, 0.5), semantic.detections(scored, 0.5))
    assert both.count() == 4


RULES = RuleSet({"MOMENT": {"later": [r"\bluego\b", r"(x?)"]}, "USE": {"enough": ["ya tengo"], "other": [r"(?:uso)", "otro"]}})


def test_catalog(spark):
    from tertulia.operators.rules import rules_table

    got = semantic.catalog_phrases(rules_table(spark, RULES).repartition(3)).orderBy("cat_id").collect()
    assert [tuple(r) for r in got] == [
        (0, "luego", "MOMENT", "later"),
        (1, "ya tengo", "USE", "enough"),
        (2, "otro", "USE", "other"),
    ]


def test_chunks(spark):
    turns = spark.createDataFrame(
        [("a", 0, "Uno dos tres. Corta. Cuatro cinco seis! Siete ocho nueve?\nDiez once doce"), ("a", 1, ""), ("b", 0, "muchas gracias")],
        "archivo string, turn_no int, texto string",
    )
    options = ChunkOptions(5, 2, 2, 1, ("muchas gracias",))
    got = semantic.chunk_turns(turns, options).orderBy("turn_no", "chunk_no").collect()
    assert [(r.archivo, r.chunk_no, r.chunk) for r in got] == [
        ("a", 0, "Uno dos tres Cuatro cinco seis"),
        ("a", 1, "Cuatro cinco seis Siete ocho nueve"),
        ("a", 2, "Siete ocho nueve Diez once doce"),
        ("a", 3, "Diez once doce"),
    ]
    own = semantic.chunk_turns(turns, ChunkOptions(1, 1, 1, 0), semantic.split_with(lambda texts: [t.split(",") for t in texts]))
    assert own.where("archivo = 'b'").first()["chunk"] == "muchas gracias"
    with pytest.raises(ValueError):
        ChunkOptions(1, 1, 2, 2)


LETTERS = "aeioutgn"


@pytest.fixture
def make_encoder():
    letters = LETTERS
    return lambda: lambda texts: np.array([[t.count(c) for c in letters] for t in texts], dtype=np.float32)


@pytest.fixture
def make_classifier():
    return lambda: lambda texts: np.array(
        ["POS" if "bien" in t else "NEG" if "mal" in t else "NEU" for t in texts]
    )


def talk(*lines):
    return "\n\n".join(f"Speaker {who}: {{ {clock} }}\n{text}" for who, clock, text in lines)


CALLS = {
    "a": talk((1, "0:00", "Luego, luego hablamos"), (2, "0:05", "va bien"), (1, "1:10", "Ya tengo uno, mal")),
    "b": talk((1, "0:00", "bien"), (3, "0:30", "mal"), (2, "0:20", "otra cosa")),
    "c": "no turns",
}


def test_detection_to_validated(spark, calls, tmp_path, make_encoder):
    log = tmp_path / "asked"
    log.mkdir()

    def complete(prompt):
        import uuid

        (log / str(uuid.uuid4())).write_text(prompt)
        if "ya tengo" in prompt:
            raise RuntimeError("down")
        return " si " if "luego" in prompt else "no"

    pieces = detection.clean_and_chunk(calls(**CALLS), CleanOptions(), ChunkOptions(2, 1, 1, 0))
    twice = pieces.union(pieces)
    found, rejects = detection.detect(twice, RULES, make_encoder, 0.7)
    assert rejects.count() == 0
    assert {"luego", "ya tengo"} <= {r.patron_mas_cercano for r in found.collect()}
    got = detection.validate(found, complete, "{phrase} {category}", ("SI",), ["tipo", "validado_llm"])
    assert got.columns[:2] == ["tipo", "validado_llm"]
    kept = got.collect()
    assert kept and {r.respuesta_llm for r in kept} == {"SI"}
    assert len(kept) == 2 * len({r.frase_original for r in kept})
    got.collect()
    prompts = [p.read_text() for p in log.iterdir()]
    assert len(prompts) == len(set(prompts)), "each prompt is asked once, also when the result is used again"


def test_prompts_are_dealt_over_the_asked_tasks(spark):
    from pyspark import TaskContext

    def complete(prompt):
        return f"{TaskContext.get().partitionId()} {prompt}"

    asked = spark.range(5000).selectExpr("cast(id as string) AS prompt_key", "concat('p', id) AS prompt")
    answers = scoring.answer_prompts(asked.union(asked), complete, tasks=16).collect()
    assert len(answers) == 5000 and {r.answer.split()[1] for r in answers} == {f"p{i}" for i in range(5000)}
    assert len({r.answer.split()[0] for r in answers}) == 16


def test_review_counts_failures(spark):
    found = spark.createDataFrame([("x", "A", None), ("y", "B", "t")], "frase_original string, categoria string, tipo string")
    reviewed = scoring.review(found, lambda p: None if p.startswith("x") else "SI", "{phrase}", ("SI",))
    assert {r.frase_original: r.validado_llm for r in reviewed.collect()} == {"x": None, "y": True}
    assert tuple(scoring.review_counts(reviewed).first()) == (2, 1)
    assert scoring.keep_validated(reviewed).count() == 1


def test_metrics_of_calls(calls, make_classifier):
    measured = call_plans.measure_calls(calls(**CALLS), make_classifier).drop("parse_error")
    got = {r.archivo: tuple(r)[1:] for r in measured.collect()}
    assert got == {"a": (70, 5, 65, -0.5, 1.0), "b": (30, 30, 0, 1.0, 0.0)}


def test_speaker_without_turns_scores_zero(calls, make_classifier):
    got = call_plans.measure_calls(calls(z=talk((3, "2:00", "mal"))), make_classifier).first()
    assert tuple(got) == ("z", 120, 0, 0, 0.0, 0.0, None)


def test_failing_models_cost_single_rows(spark, calls):
    def make_classifier():
        def classify(texts):
            if any("mal" in text for text in texts):
                raise ValueError("cannot")
            return np.array(["POS"] * len(texts))

        return classify

    good, bad = with_rejects(call_plans.measure_calls(calls(**CALLS), make_classifier))
    assert [(r.archivo, r.sentimiento_speaker1) for r in good.collect()] == [("b", 1.0)]
    assert [(r.archivo, r.parse_error) for r in bad.collect()] == [("a", "sentiment failed")]

    def make_encoder():
        def encode(texts):
            if any(text == "bad" for text in texts):
                raise ValueError("cannot")
            return np.array([[1.0, 2.0]] * len(texts), dtype=np.float32)

        return encode

    texts = spark.createDataFrame([("bad",), ("fine",), ("bad",), ("good",)], "chunk string").coalesce(1)
    encoded = semantic.encode_column(texts, "chunk", make_encoder, 2)
    assert {r.parse_error for r in with_rejects(encoded)[1].collect()} == {"ValueError: cannot"}
    got = {r.chunk: r.embedding for r in encoded.collect()}
    assert got == {"bad": None, "fine": [1.0, 2.0], "good": [1.0, 2.0]}
    alone = texts.where("chunk = 'bad'")
    assert [r.embedding for r in semantic.encode_column(alone, "chunk", make_encoder).collect()] == [None, None]


def test_summaries(calls):
    def complete(prompt):
        if "bien" in prompt:
            raise ValueError("no")
        return None if "no turns" in prompt else " resumen "

    told, silent = scoring.summarise(calls(a="hola", b="bien", c="no turns"), complete, "Resume:")
    assert [tuple(r) for r in told.collect()] == [("a", "resumen")]
    assert {r.archivo: r.error for r in silent.collect()} == {"b": "ValueError: no", "c": None}


def test_settle_uses_the_named_folder(spark):
    from tertulia.sources.staging import ensure_checkpoint_dir

    assert spark.conf.get("spark.checkpoint.dir") in ensure_checkpoint_dir(spark)
