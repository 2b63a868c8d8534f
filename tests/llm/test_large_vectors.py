"""Inner products of vectors with large components."""

import numpy as np
import pytest

from lattica.llm import vector_search


def test_large_components_are_scored_exactly(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((40, 2)))]
    # 1024 times these are 2^26 and more; the product of the last two is just below 2^63
    rows += [(100, [70_000.0, 1.0]), (101, [-65_536.0, 3.0]), (200, [2_900_000.0, 0.0]), (201, [2_900_000.5, -1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.top_inner_products(vectors, vectors.filter("vec_id % 100 = 0"), k=50)
    scaled = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = []
    for q in (0, 100, 200):
        best = sorted((-sum(a * b for a, b in zip(scaled[q], v)), i) for i, v in scaled.items() if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_scores_beyond_64_bits_raise(spark):
    vectors = spark.createDataFrame([(0, [1e9, 1.0]), (100, [1e9, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large|Overflow"):
        vector_search.top_inner_products(vectors, vectors).collect()


def test_no_finite_component_is_too_large(spark, monkeypatch):
    """Vectors of 2^63 and more when scaled take part; their scores fit where the other side is 0 there. Blocks of few rows make many rounds."""
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vector_search, "CANDIDATE_BLOCK", 2)
    monkeypatch.setattr(vector_search, "GROWTH", 2)
    rows = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (200, [-3.5, 0.0]), (1, [0.0, 1e300]), (2, [0.25, -1.7e308]), (3, [-2.0, 1e18]), (-(2**63), [0.5, 2.0])]
    rows += [(4 + i, [float(i), 1.0 / (i + 1)]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.top_inner_products(vectors, vectors.filter("vec_id % 100 = 0 and vec_id >= 0"), k=30)
    scaled = {i: [int(np.floor(1024 * x)) if abs(x) < 1e300 else int(x) * 1024 for x in v] for i, v in rows}
    want = []
    for q in (0, 100, 200):
        best = sorted((-sum(a * b for a, b in zip(scaled[q], v)), i) for i, v in scaled.items() if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
