"""Queries over whole tables against brute force."""

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from lattica import catalog
from lattica.operators import kde, lsh


@pytest.fixture(scope="module")
def embeddings(sf_dir):
    frame = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    return frame.vec_id.to_numpy(), np.stack(frame.embedding).astype(float)


def test_similarity_graph_of_all_embeddings(spark, sf_dir, embeddings):
    ids, x = embeddings
    edges = catalog.QUERIES["similarity_graph_embeddings"](spark, sf_dir).toPandas()
    want = np.exp(-np.stack([((x - y) ** 2).sum(1) for y in x]))
    place = {v: k for k, v in enumerate(ids)}
    got = np.zeros_like(want)
    got[edges.i.map(place), edges.j.map(place)] = edges.weight
    assert len(edges) == (want > 1e-10).sum() == len(ids) ** 2
    assert np.abs(got - want).max() < 1e-6


def test_near_neighbours_of_all_embeddings(spark, sf_dir, embeddings):
    ids, x = embeddings
    out = catalog.QUERIES["lsh_near_neighbors_embeddings"](spark, sf_dir).toPandas()
    functions = [lsh.MultiLSHFunction(64, catalog._FUNCTIONS, 42 * 1_000_003 + t) for t in range(catalog._TABLES)]
    together = np.any([np.equal.outer(b, b) for b in (f.of_matrix(x) for f in functions)], axis=0)
    i, j = np.nonzero(together)
    assert set(out.query_id) == set(ids)
    assert sorted(zip(out.query_id, out.id)) == sorted(zip(ids[i], ids[j]))


def test_components_of_unsold_parts(spark, tmp_path):
    for name, column, n in (("part", "p_partkey", 4), ("supplier", "s_suppkey", 3)):
        pd.DataFrame({column: range(n)}).to_parquet(tmp_path / f"{name}.parquet")
    pd.DataFrame({"l_partkey": [0, 1, 2], "l_suppkey": [0, 0, 1], "l_quantity": [1.0, 2.0, 3.0]}).to_parquet(tmp_path / "lineitem.parquet")
    out = catalog.QUERIES["components_part_supplier"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.component) for r in out) == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 0), (5, 2), (6, 6)]


def test_near_neighbours_of_many_copies(spark):
    """Copies fill one bucket of every table; their pairs are made once each, and by several tasks."""
    copies = spark.range(3000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    out = lsh.E2LSH(2, 2, copies, 2).near_neighbours(copies)
    parts = out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("query_id").alias("q"), F.sum("id").alias("p"), F.sum(F.col("query_id") * F.col("id")).alias("both")).toPandas()
    ids = 2999 * 3000 // 2
    assert parts.sum().tolist()[1:] == [3000**2, 3000 * ids, 3000 * ids, ids**2]
    assert parts.n.max() < 3000**2 / 2


@pytest.mark.parametrize("waiting", [kde.WAITING_PAIRS, 1000])
def test_similarity_graph_is_stored_in_few_bytes(spark, tmp_path, monkeypatch, waiting):
    """Both directions of all pairs and loops, once each, at less than half of the 9 bytes a row that numbers in plain order take."""
    monkeypatch.setattr(kde, "WAITING_PAIRS", waiting)
    x = np.random.default_rng(5).standard_normal((2300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] = x[8]
    ids = np.arange(2300) * 3
    pd.DataFrame({"id": ids, "x": list(x)}).to_parquet(tmp_path / "points.parquet")
    edges = kde.similarity_graph(spark.read.parquet(str(tmp_path / "points.parquet")), 1.0).edges
    catalog.rounded_fast(edges, "weight").coalesce(1).write.parquet(str(tmp_path / "edges"))
    got = pd.read_parquet(tmp_path / "edges")
    assert len(got) == 2300**2 == len(got[["i", "j"]].drop_duplicates())
    want = np.exp(-((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T))
    assert np.abs(got.weight - want[got.i // 3, got.j // 3]).max() < 1e-6
    if waiting > 1000:
        assert sum(f.stat().st_size for f in (tmp_path / "edges").glob("*.parquet")) < 4.5 * len(got)


@pytest.mark.parametrize("waiting", [1, 50, 1 << 22])
def test_layout_gives_each_pair_both_ways(monkeypatch, waiting):
    monkeypatch.setattr(kde, "WAITING_PAIRS", waiting)
    rng = np.random.default_rng(6)
    i, j, layout, want = np.arange(40), np.arange(100, 301), kde.Layout(), set()
    batches = list(layout.add(i, j, np.zeros((40, 201))))
    for k, same in enumerate((None, rng.random(40))):
        w = rng.random((40, 201)) * (rng.random((40, 201)) < 0.7)
        batches += layout.add(i, j + 1000 * k, w, same)
        r, c = np.nonzero(w)
        want |= {t for a, b, v in zip(i[r].tolist(), (j[c] + 1000 * k).tolist(), w[r, c].tolist(), strict=True) for t in ((a, b, v), (b, a, v))}
        want |= set() if same is None else {(a, a, v) for a, v in zip(i.tolist(), same.tolist(), strict=True)}
    batches += layout.rest()
    got = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert len(got) == len(want) and set(got) == want


def test_layout_gives_equal_waiting_weights_together():
    """Weights outside the common range change as often as there are different ones, not with every piece."""
    rng = np.random.default_rng(7)
    i, j, layout = np.arange(100), np.arange(100, 700), kde.Layout()
    w = 0.3 + 0.1 * rng.random((100, 600))
    rare = rng.random(w.shape) < 0.1
    w[rare] = rng.choice([0.01, 0.02, 0.7, 0.8], rare.sum())
    batches = [*layout.add(i, j, w, np.ones(100)), *layout.rest()]
    got = pd.concat([b.to_pandas() for b in batches], ignore_index=True)
    assert len(got) == len(got[["i", "j"]].drop_duplicates()) == 2 * w.size + 100
    both = got[got.i != got.j]
    assert (both.weight == w[both[["i", "j"]].min(axis=1), both[["i", "j"]].max(axis=1) - 100]).all()
    last = got.weight[got.weight.isin([0.01, 0.02, 0.7, 0.8])]
    assert len(last) == 2 * rare.sum() and (last.diff().fillna(0) != 0).sum() == 3


def test_ids_of_a_similarity_graph_are_stored_in_few_bytes(spark, tmp_path):
    x = np.random.default_rng(8).standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pd.DataFrame({"id": np.arange(2000), "x": list(x)}).to_parquet(tmp_path / "points.parquet")
    edges = kde.similarity_graph(spark.read.parquet(str(tmp_path / "points.parquet")), 1.0).edges
    catalog.rounded_fast(edges, "weight").coalesce(1).write.parquet(str(tmp_path / "edges"))
    (file,) = (tmp_path / "edges").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 2000**2
    size = [sum(meta.row_group(g).column(c).total_compressed_size for g in range(meta.num_row_groups)) / meta.num_rows for c in (0, 1)]
    assert max(size) < 0.36


def test_layout_keeps_small_large_and_negative_ids():
    i, j, layout = np.arange(30), np.arange(100, 160), kde.Layout()
    list(layout.add(i, j, np.ones((30, 60))))
    assert len(layout.waiting) == 1 and sum(x.itemsize for x in layout.waiting[0]) == 16
    layout = kde.Layout()
    rng = np.random.default_rng(9)
    batches, want = [], set()
    for shift in (0, 1 << 40, -(1 << 50)):
        w = rng.random((30, 60))
        batches += layout.add(i + shift, j + shift, w)
        want |= {t for a in range(30) for b in range(60) for t in ((a + shift, b + 100 + shift, w[a, b]), (b + 100 + shift, a + shift, w[a, b]))}
    batches += layout.rest()
    got = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert len(got) == len(want) and set(got) == want
    assert {str(b.schema.field("i").type) for b in batches} == {"int64"}
