from pyspark.sql import functions as F

from tertulia.config import CleanOptions
from tertulia.operators import parsing

CALL = """Demo call.mp3

Automatically transcribed on: 1/2/2030
Total recording length: 00:01:40

{ 0:00 }
Hello?

Speaker 2:  { 0:01 }
Buenos días, ¿cómo está?

Speaker 1:  { 0:06 }
No me interesa.
Es muy caro.

{ 0:20 }
Sigo hablando.

Speaker 3:  { 0:30 }
Otra voz.

Speaker 2:  { 0:30 }
Le cuento.

Speaker 1:  { 0:25 }
Adiós.


 ---   End of transcript   --- 

"""


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("archivo", "turn_no").select(*columns).collect()]


def test_full_turns(calls):
    got = rows(parsing.parse_turns(calls(a=CALL)), "turn_no", "speaker", "speaker_num", "timestamp", "start_sec", "text")
    assert got == [
        (0, "Speaker 2", 2, "0:01", 1, "Buenos días, ¿cómo está?"),
        (1, "Speaker 1", 1, "0:06", 6, "No me interesa.\nEs muy caro.\n\n{ 0:20 }\nSigo hablando."),
        (2, "Speaker 3", 3, "0:30", 30, "Otra voz."),
        (3, "Speaker 2", 2, "0:30", 30, "Le cuento."),
        (4, "Speaker 1", 1, "0:25", 25, "Adiós.\n\n\n ---   End of transcript   ---"),
    ]


def test_full_turns_with_context(calls):
    got = rows(parsing.parse_turns(calls(a=CALL), context_size=4), "context_before", "context_after")
    assert got == [("", "No m"), ("Buen", "Otra"), ("No m", "Le c"), ("Otra", "Adió"), ("Le c", "")]


def test_incomplete_headers_do_not_cut(calls):
    text = "Speaker 1: { 0:01 }\nuno Speaker 2: { dos\nSpeaker 2: tres\nSpeaker 2: {0:05} cuatro"
    got = rows(parsing.parse_turns(calls(a=text)), "speaker_num", "text")
    assert got == [(1, "uno Speaker 2: { dos\nSpeaker 2: tres"), (2, "cuatro")]


def test_no_turns(calls):
    assert rows(parsing.parse_turns(calls(a="nothing here", b="")), "archivo") == []
    assert rows(parsing.parse_metric_turns(calls(a="nothing here", b="")), "archivo") == []


def test_metric_turns(calls):
    got = rows(parsing.parse_metric_turns(calls(a=CALL)), "speaker", "start_sec", "duration_sec", "speech")
    assert got == [
        ("Speaker 2", 1, 5, "Buenos días, ¿cómo está?"),
        ("Speaker 1", 6, 24, "No me interesa."),
        ("Speaker 3", 30, 0, "Otra voz."),
        ("Speaker 2", 30, 0, "Le cuento."),
        ("Speaker 1", 25, 0, "Adiós."),
    ]


def test_metric_turn_without_speech_takes_the_next_header(calls):
    text = "Speaker 1: { 0:01 }\n\nSpeaker 2: { 0:04 }\nhola\nSpeaker 1: { 0:09 }\nfin  aparte"
    got = rows(parsing.parse_metric_turns(calls(a=text)), "speaker", "start_sec", "duration_sec", "speech")
    assert got == [("Speaker 1", 1, 8, "Speaker 2: { 0:04 }"), ("Speaker 1", 9, 0, "fin  aparte")]


def test_metric_header_has_one_blank(calls):
    text = "Speaker  1: { 0:01 }\nno\nSpeaker 1: { 0:02 }\nsi"
    assert rows(parsing.parse_metric_turns(calls(a=text)), "speech") == [("si",)]


def test_clean_turns(calls):
    text = "\n".join(
        [
            "Title",
            "Speaker notes that are no header",
            "lost line",
            "Speaker 1: { 0:01 } also lost",
            "  one ",
            "",
            "two",
            "   Speaker 7: { 0:02 } indented inside a turn",
            "Speaker 2:",
            "Speaker 1: { 0:09 }",
            "three",
            "Speaker x",
            "lost again",
            "  Speaker 4:  indented outside a turn",
            "four",
            " --- End of transcript ---",
        ]
    )
    df = calls(a=text).withColumnRenamed("raw", "clean")
    assert rows(parsing.parse_clean_turns(df), "turn_no", "speaker_num", "texto") == [
        (0, 1, "one two Speaker 7: { 0:02 } indented inside a turn"),
        (1, 2, ""),
        (2, 1, "three"),
        (3, 4, "four --- End of transcript ---"),
    ]


def test_clean_turns_before_any_speaker_line(calls):
    text = "Title\n Speaker 1: { 0:01 }\nhi\nthere"
    df = calls(a=text).withColumnRenamed("raw", "clean")
    assert rows(parsing.parse_clean_turns(df), "speaker_num", "texto") == [(1, "hi there")]


def clean(calls, text, **options):
    df = parsing.clean_call(calls(a=text), CleanOptions(**options))
    assert df.columns == ["archivo", "clean"]
    return df.first()["clean"]


def test_clean_call(calls):
    text = "\n".join(
        [
            "Title, One!",
            "",
            "--- Ruler ---",
            "{ 0:58 }",
            "Speaker 1:  { 0:01 } ¡Eh, Hola!",
            "Speaker 2:  { 0:01 }   ",
            "Speaker 3: no brace",
            "  ¿Qué TAL?  ",
            "   ",
        ]
    )
    assert clean(calls, text, fillers=("eh",)) == "\n".join(
        [
            "title one",
            "",
            "--- Ruler ---",
            "0 58",
            "Speaker 1:  { 0:01 } hola",
            "Speaker 2:  { 0:01 }",
            "speaker 3 no brace",
            "que tal",
            "   ",
        ]
    )


def test_clean_call_line_ends(calls):
    assert clean(calls, "A B\x0bC\n") == "a\nb\nc"
    assert clean(calls, "") == ""
    assert clean(calls, "\n\n") == "\n".join(["", ""])


def test_clean_call_as_one_text(calls):
    assert clean(calls, "Speaker 1: { 0:01 }\nHola.", keep_speakers=False) == "speaker 1 0 01 hola"


def test_cleaning_then_turns(calls):
    cleaned = parsing.clean_call(calls(a=CALL))
    assert rows(parsing.parse_clean_turns(cleaned), "speaker_num", "texto") == [
        (2, "buenos dias como esta"),
        (1, "no me interesa es muy caro 0 20 sigo hablando"),
        (3, "otra voz"),
        (2, "le cuento"),
        (1, "adios ---   End of transcript   ---"),
    ]


def test_long_texts(calls):
    blanks = " " * 200_000
    words = "palabra, " * 300_000
    text = f"Speaker 1: {{ 0:01 }}\n{words}\n{blanks}\n{words}\nSpeaker 2: {{ 0:02 }}\nfin{blanks}"
    full = rows(parsing.parse_turns(calls(a=text)), "text")
    assert full == [((words + "\n" + blanks + "\n" + words).strip(),), ("fin",)]
    assert rows(parsing.parse_metric_turns(calls(a=text)), "speech") == [(words,), ("fin" + blanks,)]
    spoken = rows(parsing.parse_clean_turns(parsing.clean_call(calls(a=text))), "texto")
    assert spoken == [(("palabra " * 600_000).strip(),), ("fin",)]


def test_parsing_needs_no_exchange(calls):
    for df in (
        parsing.parse_turns(calls(a=CALL), 10),
        parsing.parse_metric_turns(calls(a=CALL)),
        parsing.parse_clean_turns(parsing.clean_call(calls(a=CALL))),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_each_text_is_parsed_once(spark):
    df = spark.range(5).select(F.lit("a").alias("archivo"), F.concat(F.lit(CALL), "id").alias("raw"))
    plan = parsing.parse_turns(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
