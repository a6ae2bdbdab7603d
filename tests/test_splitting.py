"""Files cut into ranges of any size, against the unsplit readers."""

import json
import random

import pytest

from tertulia.sources import splitting, tables

SCHEMA = "a string, n long, inner struct<list:array<string>>"
TEXTS = ['"', "\\", '\\"', "{", "}", "[", "]", ",", "\n", "é", "\U0001f600", "x" * 40, "", '\\\\"', "a,b;c", "\r\n"]


def random_rows(rng, count):
    text = lambda: "".join(rng.choice(TEXTS) for _ in range(rng.randrange(5)))
    return [{"a": text(), "n": k, "inner": {"list": [text() for _ in range(rng.randrange(3))]}} for k in range(count)]


def rows_of(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_arrays_cut_anywhere(spark, tmp_path, range_bytes, indent, monkeypatch):
    monkeypatch.setattr(splitting, "STEP", 5)
    rng = random.Random(range_bytes)
    rows = random_rows(rng, 4 if range_bytes == 1 else 40)
    (tmp_path / "rows.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=rng.random() < 0.5), encoding="utf-8")
    split = splitting.split_json(spark, str(tmp_path), SCHEMA, range_bytes)
    whole = spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path))
    assert rows_of(split) == rows_of(whole) == sorted(json.dumps(r, sort_keys=True) for r in rows)


def test_states_compose(tmp_path):
    rng = random.Random(2)
    text = json.dumps(random_rows(rng, 30)).encode()
    import numpy as np

    whole = splitting.json_brackets(np.frombuffer(text, np.uint8), 0, 0)
    for _ in range(200):
        cut = rng.randrange(len(text) + 1)
        places, _, after, state = splitting.json_brackets(np.frombuffer(text[:cut], np.uint8), 0, 0)
        depth = int(after[-1]) if len(after) else 0
        more = splitting.json_brackets(np.frombuffer(text[cut:], np.uint8), state, depth)
        assert (places.tolist() + (more[0] + cut).tolist(), more[3]) == (whole[0].tolist(), whole[3])
        assert after.tolist() + more[2].tolist() == whole[2].tolist()


def test_lines_empty_arrays_and_several_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('{"n": 1}\n{"n": 2}\n')
    (tmp_path / "sub" / "b.json").write_text(' [ {"n": 3},\n {"n": 4} ] ')
    (tmp_path / "none.json").write_text("")
    (tmp_path / "empty.json").write_text("[]\n")
    (tmp_path / "_hidden.json").write_text("[[[")
    for size in (3, 1000):
        assert sorted(r.n for r in splitting.split_json(spark, str(tmp_path), "n long", size).collect()) == [1, 2, 3, 4]
    with pytest.raises(FileNotFoundError):
        splitting.split_json(spark, str(tmp_path / "nowhere"), "n long")


@pytest.mark.parametrize("bad", ['[{"n": 1}', '[{"n": 1}, "x", {"n": 2}]', '[{"n": 1} {"n": 2}]', '[{"n": "1}]', '[{"n": 1}, {"n": x}]', '[{"n": 1}] 7'])
def test_invalid_json_raises(spark, tmp_path, bad):
    (tmp_path / "bad.json").write_text(bad)
    with pytest.raises(Exception):
        splitting.split_json(spark, str(tmp_path), "n long").collect()


@pytest.mark.parametrize("range_bytes", [1, 9, 200, 1 << 20])
def test_tables_cut_anywhere(spark, tmp_path, range_bytes, monkeypatch):
    monkeypatch.setattr(splitting, "STEP", 3)
    rng = random.Random(range_bytes)
    pieces = [p for p in TEXTS if "\\" not in p and "\r" not in p]
    rows = [("".join(rng.choice(pieces) for _ in range(rng.randrange(5))) or "y", k, None if k % 3 else "z") for k in range(5 if range_bytes == 1 else 60)]
    given = spark.createDataFrame(rows, "a string, n long, b string")
    tables.write_final(given.coalesce(1), str(tmp_path / "t.csv"))
    split = splitting.split_table(spark, str(tmp_path / "t.csv"), "a string, n long, b string", range_bytes=range_bytes)
    whole = tables.read_table(spark, str(tmp_path / "t.csv"), "a string, n long, b string")
    assert rows_of(split) == rows_of(whole) == rows_of(given)


def test_headers_are_checked(spark, tmp_path):
    (tmp_path / "t.csv").write_text("x;y\r\n1;2\r\n\r\n3;4")
    assert rows_of(splitting.split_table(spark, str(tmp_path), "x int, y int", range_bytes=4)) == ['{"x": 1, "y": 2}', '{"x": 3, "y": 4}']
    with pytest.raises(Exception, match="header"):
        splitting.split_table(spark, str(tmp_path), "x int, z int").collect()


def test_small_ranges_share_tasks(spark, tmp_path):
    path = str(tmp_path / "out")
    table = spark.range(300).selectExpr("id", "concat('a;', id, '\n') AS b")
    tables.write_final(table.coalesce(1), path)
    split = splitting.split_table(spark, path, "id long, b string", range_bytes=20)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, table.collect()))
    assert split.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert splitting.tasks_for(spark, 1000, 1000 * splitting.RANGE) == 1000
