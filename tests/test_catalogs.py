"""Matching against large catalogs: the rows of the plain match, by fewer products."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as arrays

from tertulia.operators import catalogs, semantic

CATALOG = "cat_id int, frase string, categoria string, tipo string, embedding array<float>"
CHUNKS = "archivo string, turn_no int, chunk string, embedding array<float>"


def tables(spark, base, vectors):
    entries = [(i, f"p{i}", "c", f"t{i}", v if v is None else [float(x) for x in v]) for i, v in enumerate(base)]
    asked = [("a", i, f"chunk {i}", v if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(asked, CHUNKS), spark.createDataFrame(entries, CATALOG)


def clustered(rng, count, topics, width, spread):
    return rng.normal(size=(topics, width))[rng.integers(0, topics, count)] + rng.normal(size=(count, width)) * spread


@pytest.mark.parametrize("slice_bytes", [1 << 20, 40 * 8 * 12])
def test_equals_the_plain_match(spark, slice_bytes):
    rng = np.random.default_rng(5)
    base = clustered(rng, 400, 12, 12, 0.05)
    base[100], base[300], base[250:330:7] = base[5], 3 * base[5], base[260]
    base[33] = 0
    vectors = [*clustered(rng, 150, 5, 12, 0.4), *base[:350:9], base[300], base[33], -base[7], None]
    chunks, catalog = tables(spark, base, vectors)
    plain = {r.turn_no: r for r in semantic.best_match(chunks, catalog).collect()}
    got = catalogs.pruned_match(chunks, catalog, 8, slice_bytes)
    assert set(got.columns) == {*chunks.columns, "cat_id", "similarity", "frase", "categoria", "tipo", "compared"}
    rows = got.collect()
    assert len(rows) == len(vectors) == len(plain)
    for r in rows:
        expected = plain[r.turn_no]
        assert (r.cat_id, r.frase, r.tipo, r.chunk) == (expected.cat_id, expected.frase, expected.tipo, expected.chunk)
        assert (r.similarity is None) == (expected.similarity is None) == (vectors[r.turn_no] is None)
        assert r.similarity is None or r.similarity == pytest.approx(expected.similarity, abs=1e-12)


def test_far_groups_are_left_out(spark):
    rng = np.random.default_rng(8)
    base = clustered(rng, 1000, 20, 16, 0.02)
    vectors = base[rng.integers(0, 1000, 100)] + rng.normal(size=(100, 16)) * 0.01
    chunks, catalog = tables(spark, base, vectors)
    met = sum(r.compared for r in catalogs.pruned_match(chunks, catalog, 20).collect())
    assert 100 <= met < 0.2 * 100 * 1000
    # A chunk without a length is equally near to all entries, so it meets them all and has the first.
    zero, _ = tables(spark, base, [np.zeros(16)])
    assert [(r.cat_id, r.compared) for r in catalogs.pruned_match(zero, catalog, 20).collect()] == [(0, 1000)]


numbers = st.integers(-2, 2).map(float)


@settings(max_examples=150, deadline=None)
@given(
    arrays.arrays(float, st.tuples(st.integers(1, 30), st.just(3)), elements=numbers),
    arrays.arrays(float, st.tuples(st.integers(1, 12), st.just(3)), elements=numbers),
    st.integers(1, 6),
)
def test_groups_find_the_first_best(base, rows, pivots):
    """Small whole numbers: many equal entries, multiples, opposites and vectors without length."""
    groups = catalogs._nearest_pivot(base, base[:pivots])
    ids = np.arange(len(base), dtype=np.int32)
    order = np.lexsort((ids, groups))
    level, found, plain, compared = catalogs.Groups(ids[order], base[order], groups[order]).best(rows)
    expected = semantic.cosines(rows, base).round(semantic.DIGITS)
    assert found.tolist() == expected.argmax(axis=1).tolist()
    assert level.tolist() == expected.max(axis=1).tolist()
    assert np.allclose(plain, expected.max(axis=1), atol=1e-12) and (compared <= len(base)).all()


def test_matrices_are_bounded(monkeypatch):
    rng = np.random.default_rng(2)
    base, rows = rng.normal(size=(50, 4)), rng.normal(size=(40, 4))
    groups = catalogs.Groups(np.arange(50), base, np.zeros(50, int))
    whole = groups.best(rows)
    monkeypatch.setattr(catalogs, "SIMILARITY_CELLS", 120)
    sizes = []
    plain = semantic.cosines
    monkeypatch.setattr(catalogs, "cosines", lambda a, b: sizes.append(len(a) * len(b)) or plain(a, b))
    parts = groups.best(rows)
    assert max(sizes) <= 120 and all(np.allclose(a, b) for a, b in zip(whole, parts, strict=True))


def test_empty_tables_and_missing_vectors(spark):
    chunks, catalog = tables(spark, [[1, 0], [0, 1]], [[1, 1], [0, 2]])
    none = catalogs.pruned_match(chunks, catalog.limit(0)).collect()
    assert [(r.cat_id, r.similarity, r.compared) for r in none] == [(None, None, None)] * 2
    assert catalogs.pruned_match(chunks.limit(0), catalog).count() == 0
    assert [r.cat_id for r in sorted(catalogs.pruned_match(chunks, catalog).collect(), key=lambda r: r.turn_no)] == [0, 1]
    with pytest.raises(ValueError, match="1 catalog phrases"):
        catalogs.pruned_match(chunks, tables(spark, [[1, 0], None], [])[1])
