"""What shows on tables of several files, blocks or ids with gaps alone."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica import catalog
from lattica.graph import EDGE_SCHEMA, Graph
from lattica.operators import blocks, cluster, kde, spectrum, traversal
from lattica.plans import datasets
from lattica.sources import matrix


def test_matrix_of_several_files_keeps_their_order(spark, tmp_path):
    """Spark reads the largest file first."""
    for name, rows in (("part-00000", range(2)), ("part-00002", range(2, 700)), ("part-00010", range(700, 900))):
        (tmp_path / name).write_text("".join(f"{k} {k / 2} \n" for k in rows))
    read = matrix.load_matrix(spark, str(tmp_path)).collect()
    assert sorted((r.id, *r.x) for r in read) == [(k, k, k / 2) for k in range(900)]


def test_matrix_round_trip_keeps_ids(spark, tmp_path):
    ids = [3, 70, 7, 12, 500]
    vectors = [[0.5, 1.0], None, [2.0, 3.0], [], [4.0, 5.0]]
    pd.DataFrame({"vec_id": ids, "embedding": vectors}).to_parquet(tmp_path / "embeddings.parquet")
    out = catalog.QUERIES["matrix_round_trip"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.place, r.value) for r in out) == [(i, p, v) for i, x in sorted(zip(ids, vectors)) for p, v in enumerate(x or [])]


def points_of_groups(spark, ids):
    rng = np.random.default_rng(3)
    x = np.repeat(np.eye(3) * 2, len(ids) // 3, axis=0) + 0.3 * rng.standard_normal((len(ids), 3))
    return x, spark.createDataFrame([(int(i), row.tolist()) for i, row in zip(ids, x)], "id long, x array<double>")


@pytest.mark.parametrize("which, dense", [(spectrum.Which.SMALLEST, 0), (spectrum.Which.SMALLEST, 4000), (spectrum.Which.LARGEST, 4000)])
def test_eigenpairs_of_similarities_need_no_edges(spark, monkeypatch, which, dense):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    ids = np.random.default_rng(1).permutation(5000)[:150]
    x, points = points_of_groups(spark, ids)
    g = kde.similarity_graph(points, 0.7)
    g.edges = g.edges.limit(0)
    system = spectrum.compute_eigensystem(g, k=4, which=which, dense_vertices=dense)
    x = x[np.argsort(ids)]
    w = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(2))
    root = np.sqrt(w.sum(1) + 1)
    lap = np.eye(len(x)) - w / np.outer(root, root)
    want = np.linalg.eigvalsh(lap)
    assert list(system.values) == pytest.approx(list(want[:4] if which is spectrum.Which.SMALLEST else want[:-5:-1]), abs=1e-6)
    assert sorted(r.id for r in system.points(spark).collect()) == sorted(ids)
    v = system.vectors
    assert np.abs(lap @ v - v * system.values).max() < 1e-6 and np.abs(v.T @ v - np.eye(4)).max() < 1e-9
    labels = {r.id: r.label for r in cluster.spectral_cluster(g, 3, dense_vertices=dense).collect()}
    assert len({tuple(labels[i] for i in ids[k : k + 50]) for k in (0, 50, 100)}) == 3 == len(set(labels.values()))


def test_entries_of_similarities_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    ids = np.arange(0, 450, 3)
    x, points = points_of_groups(spark, ids)
    edges = kde.similarity_graph(points, 4.0).edges
    assert "Exchange" not in edges._jdf.queryExecution().executedPlan().toString()  # rows that are moved once per block grow with the square
    edges = edges.toPandas()
    w = np.exp(-4.0 * ((x[:, None] - x[None]) ** 2).sum(2))
    got = np.zeros_like(w)
    got[edges.i // 3, edges.j // 3] = edges.weight
    assert len(edges) == (w > 1e-10).sum() and np.abs(got - np.where(w > 1e-10, w, 0)).max() < 1e-12


@pytest.mark.parametrize("kind", [spectrum.GraphMatrix.LAPLACIAN, spectrum.GraphMatrix.NORMALISED_LAPLACIAN])
def test_null_vectors_come_from_components(spark, monkeypatch, kind):
    """A path, a triangle with a loop, an edge and an isolated vertex: no matrix is iterated with, as long as there are enough vectors."""
    half = [(0, 1, 1.0), (1, 2, 2.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (6, 7, 3.0)]
    g = Graph(spark.createDataFrame([*half, *((j, i, w) for i, j, w in half), (3, 3, 1.0)], EDGE_SCHEMA), 9)
    zeros = 3 if kind is spectrum.GraphMatrix.LAPLACIAN else 2
    with monkeypatch.context() as m:
        m.setattr(spectrum, "_filtered_subspace", None)
        system = spectrum.compute_eigensystem(g, kind, zeros, dense_vertices=0)
    dense = spectrum.compute_eigensystem(g, kind, zeros + 1)
    matrix = np.zeros((9, 9))
    for r in spectrum._matrix(g, kind).collect():
        matrix[r.i, r.j] = r.value
    assert list(system.values) == pytest.approx(list(dense.values[:zeros]), abs=1e-12) and abs(dense.values[zeros]) > 1e-3
    assert np.abs(matrix @ system.vectors).max() < 1e-12 and np.abs(system.vectors.T @ system.vectors - np.eye(zeros)).max() < 1e-12


def test_tables_of_vertices_are_not_broadcast(spark, sf_dir):
    """Their files are small, their rows aren't."""
    rings = datasets.customer_rings(spark, sf_dir)
    for rows in (rings.edges, traversal.connected_components(rings)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_millionths_are_rounded_as_decimals_are(spark):
    x = np.concatenate([np.exp(-np.linspace(0, 23, 3000)), [1.0, 0.0, 5e-7, 4.9e-7, 0.1234565]])
    rows = spark.createDataFrame([(float(v),) for v in x], "weight double").withColumn("v", F.col("weight"))
    assert all(r.weight == r.v for r in catalog.rounded(catalog.rounded_fast(rows, "weight"), "v").collect())
