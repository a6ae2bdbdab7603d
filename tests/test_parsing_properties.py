"""Random transcripts: the array expressions against plain Python over lines."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tertulia.operators import parsing

PIECES = [
    "Speaker 1: { 0:01 }", "Speaker 2:  { 1:07 }", "Speaker  3:{ 75:00}", "Speaker 12:\t{ 0:09 }  dicho aquí ", "Speaker 4:",
    "Speaker 5: sin hora }", "Speaker x", "Speaker", "  Speaker 1: { 0:30 }", "dice Speaker 2: { 0:31 } dentro", "{ 0:20 }",
    "--- fin ---", " ---   fin   --- ", "¿Hola, qué TAL?", "Ñandú; über.", "", " ", "\t", " ", "total recording length: 1",
    "Speaker 6: { 0:59", "}", "speaker 1: { 0:01 }", "a b", "c\x0bd\x1ce", "Speaker 7: { 0:02 }",
]
CALLS = st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("\n".join), min_size=30, max_size=60)
OFTEN = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def table(spark, texts, column):
    return spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(texts)], f"archivo string, {column} string")


def grouped(df, texts, *columns):
    out = [[] for _ in texts]
    for r in df.orderBy("archivo", "turn_no").collect():
        out[int(r.archivo)].append(tuple(r[c] for c in columns))
    return out


def spoken(text):
    turns, current = [], None
    for line in text.splitlines():
        if current is None or line.startswith("Speaker"):
            header = re.match(r"Speaker\s+(\d+):", line.strip())
            current = [] if header else None
            if header:
                turns.append((int(header[1]), current))
        elif line.strip():
            current.append(line.strip())
    return [(number, " ".join(words)) for number, words in turns]


@OFTEN
@given(texts=CALLS)
def test_full_turns(spark, texts):
    header = r"(Speaker\s+(\d+)):\s*\{\s*(\d+:\d+)\s*\}"

    def expected(text):
        found = list(re.finditer(header, text))
        ends = [m.start() for m in found[1:]] + [len(text)]
        return [(m[1], int(m[2]), m[3], text[m.end():end].strip()) for m, end in zip(found, ends, strict=False)]

    got = grouped(parsing.parse_turns(table(spark, texts, "raw")), texts, "speaker", "speaker_num", "timestamp", "text")
    assert got == [expected(t) for t in texts]


#: Transcripts, and their turns as (speaker, start, duration, speech).
MEASURED = {
    "Speaker 1: { 0:01 }\nbuenas\notra línea\nSpeaker 2:{0:09}\n  adiós ": [
        ("Speaker 1", 1, 8, "buenas"), ("Speaker 2", 9, 0, "adiós "),
    ],
    "Speaker 7: { 1:07 } en la misma línea\n\nSpeaker 7: { 75:00 }\nmás tarde": [
        ("Speaker 7", 67, 4433, "en la misma línea"), ("Speaker 7", 4500, 0, "más tarde"),
    ],
    "Speaker 2: { 0:50 }\nantes\nSpeaker 1: { 0:20 }\nhacia atrás\nSpeaker 2: { 0:25 }\nfin": [
        ("Speaker 2", 50, 0, "antes"), ("Speaker 1", 20, 5, "hacia atrás"), ("Speaker 2", 25, 0, "fin"),
    ],
    # a silent turn takes the next header as its speech
    "Speaker 1: { 0:01 }\n\nSpeaker 2: { 0:04 }\nsí\nSpeaker 1: { 0:06 }\nno": [
        ("Speaker 1", 1, 5, "Speaker 2: { 0:04 }"), ("Speaker 1", 6, 0, "no"),
    ],
    # two blanks after the word, an hour, a missing bracket, and a bare time are no headers
    "Speaker  1: { 0:01 }\nx\nSpeaker 1: { 1:00:01 }\ny\nSpeaker 1: { 0:02\nz\n{ 0:03 }\nSpeaker 3: { 0:04 }\nw\n{ 0:05 }": [
        ("Speaker 3", 4, 0, "w"),
    ],
    "dice Speaker 9: { 0:31 } dentro": [("Speaker 9", 31, 0, "dentro")],
    "Speaker 1: { 0:01 }": [("Speaker 1", 1, 0, "")],
    "nada": [],
    "": [],
}


def test_metric_turns(spark):
    df = parsing.parse_metric_turns(table(spark, list(MEASURED), "raw"))
    assert grouped(df, list(MEASURED), "speaker", "start_sec", "duration_sec", "speech") == list(MEASURED.values())


@OFTEN
@given(texts=CALLS)
def test_clean_turns(spark, texts):
    df = parsing.parse_clean_turns(table(spark, texts, "clean"))
    assert grouped(df, texts, "speaker_num", "texto") == [spoken(t) for t in texts]


CLEANED = {
    "Speaker 1: { 0:01 }  ¡Hola, QUÉ tal!": "Speaker 1: { 0:01 } hola que tal",
    "Speaker  3:{ 75:00}": "Speaker  3:{ 75:00}",
    "Speaker 4: sin hora": "speaker 4 sin hora",
    "  Speaker 1: { 0:30 } Eh": "speaker 1 0 30 eh",
    " ---   fin   --- ": " ---   fin   --- ",
    "a\n\n \t\nB.": "a\n\n \t\nb",
    "Ñandú; über.\r\nUNO": "nandu uber\nuno",
    "x\n": "x",
    "": "",
}


def test_clean_call(spark):
    df = parsing.clean_call(table(spark, list(CLEANED), "raw")).orderBy("archivo")
    assert [r.clean for r in df.collect()] == list(CLEANED.values())


@OFTEN
@given(texts=CALLS)
def test_cleaning_keeps_headers_and_lines(spark, texts):
    once = [r.clean for r in parsing.clean_call(table(spark, texts, "raw")).orderBy("archivo").collect()]
    header = re.compile(r"^Speaker\s+\d+:.*?\}", re.MULTILINE)
    for text, clean in zip(texts, once, strict=True):
        assert len(clean.split("\n")) == max(1, len(text.splitlines()))
        # ``$`` of the lines: what a header line keeps is the header itself
        assert [h for line in text.splitlines() for h in header.findall(line)] == header.findall(clean)
    twice = parsing.clean_call(table(spark, once, "raw")).orderBy("archivo")
    assert [r.clean for r in twice.collect()] == [c.removesuffix("\n") for c in once]
