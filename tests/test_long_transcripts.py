"""Transcripts read in ranges against the same files read whole."""

import random

import pytest
from pyspark.sql import functions as F

from tertulia.operators.parsing import parse_turns
from tertulia.sources import long_transcripts
from tertulia.sources.long_transcripts import read_long_turns
from tertulia.sources.transcripts import read_transcripts, with_rejects

NAMES = ("archivo", "turn_no", "speaker", "speaker_num", "timestamp", "start_sec", "text")
PARTS = [
    "Speaker 1: { 0:05 }\n", "Speaker 2:{1:10}", "Speaker 3 :", "Speaker \n\n 4:\r\n {2:00\t}\r\n", "Speaker", "SpeakerSpeaker 7: {3:00}",
    "Speak", "er 1: {0:00}", "hola", " ", "Speaker\u00a05:\u2003{4:00}", "Speaker ٣: {0:01}", "\r\n", "\n\n", "ñandú 😀 ", "{ 0:09 }", "Speaker 12: { x }", "una frase más larga que un intervalo, ",
]


def whole(spark, path):
    good, _ = with_rejects(read_transcripts(spark, path))
    return sorted(tuple(r) for r in parse_turns(good).select(*NAMES).collect())


def cut(spark, path, **options):
    return sorted(tuple(r) for r in read_long_turns(spark, path, min_bytes=0, **options)[0].select(*NAMES).collect())


@pytest.mark.parametrize("range_bytes", [5, 64, 1024, 1 << 20])
def test_equals_the_whole_files(spark, folder, range_bytes):
    draw = random.Random(11)
    sizes = (3, 8, 20) if range_bytes == 5 else (0, 1, 5, 40, 400)
    texts = {f"r{n}__txt": "".join(draw.choices(PARTS, k=n)) for n in sizes}
    texts |= {"silent__txt": "no header " * 20, "one__txt": "Speaker 1: {0:00}" + " word" * 50, "empty__txt": "", "other__csv": PARTS[0]}
    path = folder(**texts)
    expected = whole(spark, path)
    assert len({r[0] for r in expected}) > 2
    assert cut(spark, path, range_bytes=range_bytes) == expected


def test_headers_at_the_ends_of_steps(tmp_path, monkeypatch):
    monkeypatch.setattr(long_transcripts, "STEP", 10)
    file = tmp_path / "a.txt"
    for place in range(0, 30):
        file.write_bytes(b"x" * place + b"Speaker 1: {0:00}" + b"Speaker" + b"Speaker 2: {0:00}")
        assert long_transcripts.first_header(str(file), 0, 71) == place
        assert long_transcripts.first_header(str(file), 0, place) is None
        assert long_transcripts.first_header(str(file), place, place + 1) == place
        assert long_transcripts.first_header(str(file), place + 1, place + 41) == place + 24


def test_a_header_too_long_to_be_cut_at(spark, folder, monkeypatch):
    monkeypatch.setattr(long_transcripts, "LONGEST", 8)
    path = folder(a__txt="x Speaker 1: {" + " " * 100 + "0:00} one Speaker 2: {0:01} two " + "Speaker 1: {0:02}" + " three" * 30)
    assert cut(spark, path, range_bytes=16) == whole(spark, path)


def test_a_long_file_is_many_tasks(spark, folder):
    said = "".join(f"Speaker {1 + n % 2}: {{ {n // 60}:{n % 60:02d} }}\nturn {n} ñ\n\n" for n in range(4000))
    path = folder(long__txt=said, short__txt="Speaker 1: {0:00} a")
    turns, rejects = read_long_turns(spark, path, min_bytes=1000, range_bytes=4096)
    rows = sorted(turns.collect(), key=lambda r: r.turn_no)
    assert [r.turn_no for r in rows] == list(range(4000)) and [r.text for r in rows] == [f"turn {n} ñ" for n in range(4000)]
    assert {r.archivo for r in rows} == {"long.txt"} and rejects.count() == 0
    assert {r.path for r in rows} == {f"{path}/long.txt"}
    pieces = long_transcripts.read_pieces(spark, path, 1000, 4096)
    assert pieces.select(F.spark_partition_id()).distinct().count() > 10


def test_unusable_pieces(spark, folder):
    path = folder(
        bad__txt=b"Speaker 1: {0:00} one" + b"Speaker 2: {0:01} \xff" + b"Speaker 1: {0:02} three",
        large__txt="Speaker 1: {0:00} a" + "Speaker 2: {0:01} " + "b" * 500 + "Speaker 1: {0:02} c",
    )
    turns, rejects = read_long_turns(spark, path, min_bytes=0, range_bytes=10, max_bytes=100)
    assert sorted((r.archivo, r.turn_no, r.text) for r in turns.collect()) == [
        ("bad.txt", 0, "one"), ("bad.txt", 1, "three"), ("large.txt", 0, "a"), ("large.txt", 1, "c"),
    ]
    assert sorted((r.archivo, r.cut, r.parse_error) for r in rejects.collect()) == [
        ("bad.txt", 21, "not valid UTF-8"), ("large.txt", 19, "turn too large"),
    ]


def test_same_names_in_several_folders_and_none(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "call.txt").write_text(f"Speaker 1: {{0:00}} {name}1 Speaker 2: {{0:05}} {name}2")
    turns, _ = read_long_turns(spark, f"{tmp_path}/*", min_bytes=0, range_bytes=16)
    got = sorted((r.path[-10:], r.turn_no, r.text) for r in turns.collect())
    assert got == [("a/call.txt", 0, "a1"), ("a/call.txt", 1, "a2"), ("b/call.txt", 0, "b1"), ("b/call.txt", 1, "b2")]
    turns, rejects = read_long_turns(spark, f"{tmp_path}/*", min_bytes=1 << 20)
    assert turns.count() == 0 and rejects.count() == 0


def test_small_ranges_share_tasks(spark, folder):
    path = folder(many__txt="".join(f"Speaker {n % 3}: {{{n}:00}}\nword {n}\n" for n in range(300)))
    pieces = long_transcripts.read_pieces(spark, path, min_bytes=0, range_bytes=64)
    assert pieces.count() > 50
    assert pieces.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert cut(spark, path, range_bytes=64) == whole(spark, path)
