import numpy as np
import pytest

from lattica.llm import vector_search


def brute(rows, queries, k):
    usable = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v) == 8}
    out = []
    for q in queries:
        if q in usable:
            best = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1024, 8192), (3, 16)])
def test_exact_search(spark, monkeypatch, blocks):
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(vector_search, "CANDIDATE_BLOCK", blocks[1])
    rng = np.random.default_rng(1)
    scale = rng.choice([0.1, 1.0, 5.0], 300)
    rows = [(i, (rng.standard_normal(8) * scale[i]).astype(np.float32).astype(float).tolist()) for i in range(300)]
    rows += [(400 + k, rows[0][1]) for k in range(30)]  # a vector that many rows have
    rows += [(500, [0.0] * 8), (600, None), (700, [None] * 8), (800, [float("nan")] * 8), (900, [float("inf"), *[0.0] * 7]), (1000, []), (1100, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, block int, id string").repartition(4)
    got = vector_search.top_inner_products(vectors, vectors.filter("vec_id % 100 = 0"), k=10)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, range(0, 1200, 100), 10)


def test_few_and_no_rows(spark):
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (100, [3.0, -1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in vector_search.top_inner_products(vectors, vectors).collect())
    assert [g[:3] for g in got] == [(0, 1, 100), (100, 1, 0)]
    assert vector_search.top_inner_products(vectors.limit(0), vectors).count() == 0 == vector_search.top_inner_products(vectors, vectors.limit(0)).count()
