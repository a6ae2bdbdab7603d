import pytest
from pyspark.sql import functions as F

from tertulia import schemas
from tertulia.operators import dashboard
from tertulia.operators.calls import final_calls, join_detections
from tertulia.sources import tables

METRICS = schemas.CALL_METRICS
FOUND = "archivo_origen string, frase_original string, categoria string, exito string, turn_no int"


@pytest.fixture
def metrics(spark):
    return spark.createDataFrame(
        [(60, 10, 20, 0.5, 0.1, " a "), (120, 30, 40, -0.5, 0.0, "b"), (30, 0, 0, 0.0, 0.0, None)], METRICS
    )


@pytest.fixture
def final(spark, metrics):
    found = spark.createDataFrame(
        [("a", "f1", "x, y,,", "si", 0), ("a\n", "f2", None, "no", 1), (None, "f3", "x", "si", 0), ("zz", "f4", "w", "si", 0)],
        FOUND,
    )
    summaries = spark.createDataFrame([("a ", "ra"), ("b", "rb1"), ("b", "rb2"), (None, "rn")], schemas.SUMMARIES)
    return final_calls(metrics, found, summaries)


def test_final_table(final):
    rows = sorted((r.archivo or "", r.frase_original or "", r.resumen, r.duracion_total_seg) for r in final.collect())
    assert rows == [
        ("", "f3", "rn", 30),
        ("a", "f1", "ra", 60),
        ("a", "f2", "ra", 60),
        ("b", "", "rb1", 120),
        ("b", "", "rb2", 120),
    ]
    assert final.columns[-1] == "resumen" and final.columns.count("archivo") == 1


def test_equals_a_left_join(spark):
    left = spark.range(40).select(F.concat(F.lit("c"), F.col("id") % 30).alias("archivo"), F.col("id").alias("m"))
    right = spark.range(600).selectExpr(
        "CASE WHEN id < 400 THEN 'c7' ELSE concat('c', id % 50) END AS archivo", "id AS d", "'k' AS categoria"
    )
    got = join_detections(left, right).select("archivo", "m", "d", "categoria")
    expected = left.join(right, "archivo", "left").select("archivo", "m", "d", "categoria")
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def test_hot_call_is_split_by_the_adaptive_join(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = spark.range(300).select(F.concat(F.lit("c"), "id").alias("archivo"), F.lit(1).alias("m"))
        right = spark.range(0, 30000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, "c1").otherwise(F.concat(F.lit("c"), F.col("id") % 400)).alias("archivo"),
            F.sha2(F.col("id").cast("string"), 256).alias("d"),
        )
        joined = join_detections(left, right)
        assert joined.count() == left.join(right, "archivo", "left").count()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_kpis(final):
    all_calls = dashboard.call_kpis(final).first()
    assert tuple(all_calls) == ("Varias", "Varias", 0.02, 1.3, "Múltiples llamadas")
    one = dashboard.call_kpis(final, "a").first()
    assert tuple(one) == ("a", "No", 0.3, 1.0, "ra")
    by_call = {r.id_llamada: r for r in dashboard.kpis_by_call(final).collect()}
    assert by_call["a"] == one and by_call["Varias"] == all_calls and len(by_call) == 4
    assert (by_call[None].exito, by_call["b"].exito) == ("Sí", "No")
    assert dashboard.success_flag(final).first()[0] == "Varias"
    assert dashboard.success_flag(final, "a").first()[0] == "No"
    assert dashboard.sentiment_kpi(final, "b").first()[0] == -0.25
    assert dashboard.duration_kpi(final, "b").first()[0] == 2.0
    assert dashboard.call_summary(final, "a").first()[0] == "ra"
    assert dashboard.call_summary(final).first()[0] == "Múltiples llamadas"


def test_kpis_without_the_columns(final):
    bare = final.drop("sentimiento_speaker1", "duracion_total_seg")
    assert tuple(dashboard.call_kpis(bare, "a").first()) == ("a", "No", None, None, "ra")


def test_each_call_once(final):
    got = dashboard.per_call_means(final).first()
    assert tuple(got) == (0.017, 1.17)


def test_lists(final):
    assert [r[0] for r in dashboard.call_list(final).collect()] == ["Todas", "a", "b"]
    spread = {r.categoria: r.cantidad for r in dashboard.category_distribution(final).collect()}
    assert spread == {"x": 2, "y": 1}
    assert {r.categoria for r in dashboard.category_distribution(final, "a").collect()} == {"x", "y"}
    detail = sorted((r[0] or "", r[1] or "") for r in dashboard.phrase_detail(final).collect())
    assert detail == [("", ""), ("", ""), ("f1", "x, y,,"), ("f2", ""), ("f3", "x")]
    assert dashboard.preview(final, 2).count() == 2


def test_delimited_round_trip(spark, final, tmp_path):
    path = str(tmp_path / "final")
    odd = final.withColumn("resumen", F.lit('two\nlines; "quoted" \\ and ñ '))
    tables.write_final(odd, path)
    back = tables.read_table(spark, path, odd.schema.simpleString()[7:-1].replace(":", " "))
    assert sorted(map(str, back.collect())) == sorted(map(str, odd.collect()))
    commas = str(tmp_path / "commas")
    tables.write_final(final, commas, sep=",")
    assert tables.read_table(spark, commas, final.schema.simpleString()[7:-1].replace(":", " "), ",").count() == 5


def test_delimited_header_must_fit(spark, tmp_path):
    (tmp_path / "t.csv").write_text("archivo;otro\na;b\n")
    with pytest.raises(Exception):
        tables.read_table(spark, str(tmp_path / "t.csv"), schemas.SUMMARIES).collect()


def test_detections_file(spark, tmp_path):
    good = tmp_path / "d.json"
    good.write_text('[{"archivo_origen": "a", "similitud": 0.5, "frase_original": "ñ"},\n {"archivo_origen": "b"}]')
    got = tables.read_detections(spark, str(good)).collect()
    assert [(r.archivo_origen, r.similitud, r.tipo) for r in got] == [("a", 0.5, None), ("b", None, None)]
    (tmp_path / "bad.json").write_text('[{"archivo_origen": ')
    with pytest.raises(Exception):
        tables.read_detections(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(Exception):
        tables.read_detections(spark, str(tmp_path / "missing.json")).collect()
    (tmp_path / "l.json").write_text('{"archivo_origen": "a"}\n{"archivo_origen": "b"}\n')
    assert tables.read_detections(spark, str(tmp_path / "l.json"), json_lines=True).count() == 2


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` Archivó ` int, `Duración Ñ` int, c int")
    assert tables.normalise_columns(df).columns == ["archivo", "duracion n", "c"]
    with pytest.raises(ValueError):
        tables.normalise_columns(spark.createDataFrame([(1, 2)], "`é` int, e int"))
    assert tables.order_columns(df, ["c", "none"]).columns == ["c", " Archivó ", "Duración Ñ"]


def test_summaries_are_fetched_after_the_numbers(spark):
    rows = [
        ("a", 2, 1, "si", 10, "second"), ("a", 1, 5, "no", 20, "first"), ("a", 1, 7, "si", 30, "third"),
        ("b", None, None, None, 40, None), ("c", 3, 1, "no", 5, "z"), ("c", 3, 1, "no", 5, "y"), ("c", 3, 1, "no", 5, None),
        (None, 9, 9, "si", 7, "nameless"), ("d", 1, None, "si", 1, "null first"), ("d", 1, 0, "si", 1, "then"),
    ]
    schema = "archivo string, turn_no int, rule_no int, exito string, duracion_total_seg int, resumen string"
    final = spark.createDataFrame(rows, schema)
    figures = dashboard.kpis_by_call(final)
    assert {r.id_llamada: (r.exito, r.resumen, r.duracion_prom_min) for r in figures.collect()} == {
        "a": ("Sí", "first", 0.33), "b": ("No", None, 0.67), "c": ("No", "y", 0.08), None: ("Sí", "nameless", 0.12),
        "d": ("Sí", "null first", 0.02), "Varias": ("Varias", "Múltiples llamadas", 0.21),
    }
    plan = figures._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Expand" not in plan
    assert dashboard.kpis_by_call(final.limit(0)).count() == 0
    assert {r.resumen for r in dashboard.kpis_by_call(final.where("archivo = 'a'"), order=()).collect()} == {"first", "Múltiples llamadas"}
