import json

import pytest

from tertulia.config import ReportOptions, RuleSet
from tertulia.operators import parsing, reports, rules
from tertulia.plans import objections
from tertulia.sources.transcripts import write_reports

RULES = RuleSet(
    {
        "MOMENT": {"later": ["luego", "el lunes"]},
        "COST": {"high": ["sale caro", "no lo pago"]},
        "SAFETY": {"cover": ["garantia"]},
    },
    {"high": 5, "cover": 2},
)


def transcript(*lines):
    return "\n\n".join(f"Speaker {who}:  {{ 0:{second:02d} }}\n{text}" for who, second, text in lines)


SAID = {2: "Mejor el lunes", 8: "luego, que sale caro", 14: "¿Y la garantía?", 18: "No lo pago"}
CALL = transcript(*[(1 + i % 2, i, SAID.get(i, f"t{i}")) for i in range(21)])


def stats(spark, calls_table):
    return objections.analyse_corpus(calls_table, RULES).first().asDict()


def test_report_of_a_call(calls):
    r = objections.analyse_calls(calls(a=CALL), RULES).first()
    assert (r.file, r.total_turns, r.client_turns, r.objections_found) == ("a", 21, 11, 5)
    assert r.objection_types == {"MOMENT": 2, "COST": 2, "SAFETY": 1}
    assert r.type_order == ["MOMENT", "COST", "SAFETY"]
    assert r.avg_intensity == 14 / 5
    assert [(o.type, o.intensity, o.timestamp) for o in r.objections] == [
        ("MOMENT", 1, "0:02"), ("MOMENT", 1, "0:08"), ("COST", 5, "0:08"), ("SAFETY", 2, "0:14"), ("COST", 5, "0:18"),
    ]
    assert r.objections[3].asDict() == {
        "type": "SAFETY", "intensity": 2, "matched_text": "garantia", "pattern": "garantia", "timestamp": "0:14",
        "speaker": "Speaker 1", "full_text": "¿Y la garantía?", "context_before": "t13", "context_after": "t15",
    }
    assert len(r.turns) == 21
    assert r.turns[8].asDict() == {"speaker": "Speaker 1", "speaker_num": 1, "timestamp": "0:08", "text": "luego, que sale caro"}


def test_report_needs_no_exchange(calls):
    plan = objections.analyse_calls(calls(a=CALL), RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_report_options(calls):
    small = ReportOptions(client_speaker=2, include_turns=False, include_details=False, include_intensity=False)
    df = objections.analyse_calls(calls(a=CALL), RULES, small)
    assert df.columns == ["file", "total_turns", "client_turns", "objections_found", "objection_types", "type_order"]
    assert df.first().objections_found == 0


def test_client_of_each_call(spark):
    table = spark.createDataFrame([("a", CALL, 2), ("b", CALL, None)], "archivo string, raw string, client int")
    got = {r.file: r.objections_found for r in objections.analyse_calls(table, RULES, client="client").collect()}
    assert got == {"a": 0, "b": 5}


def test_call_without_objections_or_turns(calls):
    rows = objections.analyse_calls(calls(a=transcript((1, 0, "hola")), b="nothing"), RULES).orderBy("file").collect()
    assert [(r.total_turns, r.objections_found, r.objection_types, r.avg_intensity) for r in rows] == [
        (1, 0, {}, 0.0),
        (0, 0, {}, 0.0),
    ]


def test_row_and_table_forms_agree(calls):
    table = calls(
        a=CALL,
        b=transcript((1, 0, "garantía luego garantía"), (2, 1, "luego"), (1, 2, "no lo pago, sale caro")),
        c=transcript((2, 0, "hola")),
    )
    inside = objections.analyse_calls(table, RULES).orderBy("file")
    matched = rules.match_rules(parsing.parse_turns(table), RULES, 1)
    common = ["file", "total_turns", "client_turns", "objections_found", "objection_types", "type_order", "avg_intensity"]
    by_table = reports.call_report(matched, RULES.types).orderBy("file")
    assert inside.select(*common).collect() == by_table.select(*common).collect()

    for size, count in ((5, 5), (8, 3), (21, 1), (512, 1)):
        parts = reports.document_parts(matched, turns_per_part=size).orderBy("file", "part").collect()
        assert len([p for p in parts if p.file == "a"]) == count
        for r in inside.collect():
            mine = [p for p in parts if p.file == r.file]
            assert [o for p in mine for o in p.objections] == r.objections
            assert [t for p in mine for t in p.turns] == r.turns

    listed = objections.list_objections(table, RULES)
    counts = {r.archivo: (r.total_turns, r.client_turns, r.objections_found, r.avg_intensity)
              for r in reports.call_counts(parsing.parse_turns(table), listed).collect()}
    assert counts == {r.file: (r.total_turns, r.client_turns, r.objections_found, r.avg_intensity) for r in inside.collect()}
    types = {r.archivo: r.objection_types for r in reports.type_counts(listed).collect()}
    assert types == {r.file: r.objection_types for r in inside.collect() if r.objection_types}


def test_one_exchange_for_the_report(spark):
    table = spark.range(10).selectExpr(
        "'a' AS archivo", "CAST(id AS int) AS turn_no", "1 AS speaker_num", "'luego' AS text"
    )
    plan = reports.call_report(rules.match_rules(table, RULES, 1), RULES.types)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "collect_list" not in plan


def test_most_common_type_counts_calls(spark, calls):
    table = calls(
        a=transcript((1, 0, "luego"), (1, 1, "luego"), (1, 2, "luego")),
        b=transcript((1, 0, "garantía")),
        c=transcript((1, 0, "la garantía sale caro")),
        d=transcript((1, 0, "nada")),
    )
    got = stats(spark, table)
    assert got["most_common_objection"] == "SAFETY"
    assert (got["total_files"], got["total_objections"]) == (4, 6)
    assert got["avg_objections_per_file"] == 1.5
    assert got["overall_avg_intensity"] == (1 + 2 + 3.5 + 0) / 4


def test_tie_goes_to_the_type_seen_first(spark, calls):
    table = calls(b=transcript((1, 0, "luego")), a=transcript((1, 0, "hola"), (1, 1, "garantía")), c=transcript((1, 0, "sale caro")))
    assert stats(spark, table)["most_common_objection"] == "SAFETY"
    within = calls(a=transcript((1, 0, "garantía"), (1, 1, "luego")))
    assert stats(spark, within)["most_common_objection"] == "SAFETY"


def test_no_calls(spark, calls):
    assert stats(spark, calls(a="x").where("false")) == {
        "total_files": 0,
        "total_objections": 0,
        "avg_objections_per_file": 0.0,
        "most_common_objection": None,
        "overall_avg_intensity": 0.0,
    }


def test_without_intensities_the_mean_is_zero(calls):
    plain = ReportOptions(include_intensity=False)
    assert objections.analyse_corpus(calls(a=CALL), RULES, plain).first().overall_avg_intensity == 0.0


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_write_reports(spark, calls, tmp_path, fmt):
    path = str(tmp_path / "out")
    write_reports(objections.analyse_calls(calls(a=CALL, b=""), RULES), path, fmt=fmt)
    back = {r.file: r for r in spark.read.format(fmt).load(path).collect()}
    assert back["a"].objections_found == 5 and len(back["a"].turns) == 21 and back["b"].turns == []
    if fmt == "json":
        lines = [json.loads(line) for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
        assert {line["file"] for line in lines} == {"a", "b"}
