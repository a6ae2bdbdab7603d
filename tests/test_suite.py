"""Every query against its SQL twin on the smallest data set, where that and the other engine are at hand."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from tertulia.suite.oracles import ORACLES
from tertulia.suite.queries import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="no test data")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else repr(v) for v in (row[i] for i in order)) for row in rows)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, engine, name):
    result = entry_points.queries()[name](spark, str(FOLDER))
    expected = engine.sql(entry_points.oracle_sql()[name])
    assert sorted(result.columns) == sorted(expected.columns)
    rows = [tuple(r) for r in result.collect()]
    assert canonical(rows, result.columns) == canonical(expected.fetchall(), expected.columns)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_detection_arrays_are_bounded(spark, tmp_path, monkeypatch):
    import json

    from tertulia.suite import queries

    vectors = spark.range(2500).selectExpr("id AS vec_id", "array(1f, 2f) AS embedding", "1 AS label")
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(queries, "fresh_folder", lambda spark, name: str(tmp_path / name))
    assert queries.detection_array(spark, str(tmp_path)).count() == 2500
    arrays = [json.loads(file.read_text()) for file in (tmp_path / "arrays").rglob("*.txt")]
    assert sorted(map(len, arrays)) == [500, 1000, 1000]
