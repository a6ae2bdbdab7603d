"""The graph index, against brute force."""

from pathlib import Path

import numpy as np
import pytest

from tertulia.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, shard string, dim string, rank string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "s", "d", "r") for i, v in rows], SCHEMA).repartition(3)


def found_by(spark, rows, query, k=20, **options):
    found = hnsw.nearest(vectors(spark, rows), query, k, **options)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for several in out.values():
        assert [r for r, _, _ in several] == list(range(1, len(several) + 1))
    return {q: [(i, s) for _, i, s in several] for q, several in out.items()}


def brute(rows, wanted, k=20):
    ids = np.array([i for i, _ in rows])
    own = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for q in np.flatnonzero(wanted(ids)):
        products = (own * own[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -products)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), products[j]) for j in order]
    return out


def recall(found, true):
    assert found.keys() == true.keys()
    return np.mean([len({i for i, _ in found[q]} & {i for i, _ in true[q]}) / len(true[q]) for q in true])


TWENTIETH = "vec_id % 20 = 0"


@pytest.mark.parametrize("spread", [0.0, 0.6])
def test_recall_over_several_shards(spark, spread):
    rng = np.random.RandomState(4)
    own = rng.randn(3000, 24) * rng.lognormal(0, spread, (3000, 1))
    rows = list(enumerate(own.tolist()))
    found, true = found_by(spark, rows, TWENTIETH, shard_rows=1000), brute(rows, lambda i: i % 20 == 0)
    assert recall(found, true) >= 0.95
    given = np.array(own, np.float32).astype(np.float64)
    for q, several in found.items():
        assert [s for _, s in several] == sorted((s for _, s in several), reverse=True) and len(several) == 20
        for i, score in several:
            assert i != q and score == pytest.approx(given[q] @ given[i], abs=1e-12)


def test_copies_and_near_copies_of_one_vector(spark):
    rng = np.random.RandomState(5)
    own = rng.randn(1500, 16)
    own[:500] = own[0]
    own[500:1000] = own[500] + rng.randn(500, 16) * 1e-3
    rows = list(enumerate(own.tolist()))
    found, true = found_by(spark, rows, TWENTIETH, shard_rows=500), brute(rows, lambda i: i % 20 == 0)
    assert recall(found, true) >= 0.95
    for q in range(0, 500, 20):
        assert [i for i, _ in found[q]] == [i for i in range(21) if i != q][:20]


def test_fewer_candidates_than_asked_for(spark):
    rng = np.random.RandomState(6)
    rows = [(i, (rng.randn(5) * 10.0 ** (i % 4)).tolist()) for i in range(21)]
    found, true = found_by(spark, rows, TWENTIETH), brute(rows, lambda i: i % 20 == 0)
    assert [[i for i, _ in found[q]] for q in (0, 20)] == [[i for i, _ in true[q]] for q in (0, 20)]
    assert {len(several) for several in found.values()} == {20}
    assert [i for i, _ in found_by(spark, rows[:4], TWENTIETH)[0]] == [i for i, _ in brute(rows[:4], lambda i: i == 0)[0]]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [2, 0]), (2, [0, 0]), (3, None), (4, [nan, 1]), (5, [inf, 1]), (6, [None, 1]), (7, []), (None, [1, 1])]
    rows += [(20, [0, 0]), (40, None), (60, [-inf, 0]), (8, [-1, 5]), (9, [1, 1, 1]), (80, [1, 1, 1]), (1, [2, 0]), (8, [-1, 4])]
    assert found_by(spark, rows, TWENTIETH) == {0: [(1, 2.0), (8, -1.0)], 80: [(9, 3.0)]}


def test_one_row_and_none(spark):
    assert found_by(spark, [(0, [1, 2])], TWENTIETH) == {}
    assert found_by(spark, [], TWENTIETH) == {}


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    rng = np.random.RandomState(7)
    rows = list(enumerate(rng.randn(400, 8).tolist()))
    whole = found_by(spark, rows, "true", k=3, shard_rows=150)
    monkeypatch.setattr(hnsw, "BLOCK", 60)
    assert found_by(spark, rows, "true", k=3, shard_rows=150) == whole


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").is_dir(), reason="no test data")
def test_recall_on_the_given_vectors(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r.vec_id, r.embedding) for r in given]
    assert recall(found_by(spark, rows, TWENTIETH), brute(rows, lambda i: i % 20 == 0)) >= 0.98
