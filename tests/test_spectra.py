"""Eigenpairs whose vectors stay in tables."""

import math

import numpy as np
import pytest

from lattica.graph import EDGE_SCHEMA, Graph, barbell_graph, complete_graph, cycle_graph
from lattica.operators import cluster, metrics, random_graphs, spectrum


def residuals(g, system):
    n = g.n
    a, loops = np.zeros((n, n)), np.zeros(n)
    for r in g.edges.collect():
        a[r.i, r.j] += r.weight
        loops[r.i] += r.weight if r.i == r.j else 0
    d = a.sum(1) + loops
    lap = np.eye(n) - a / np.sqrt(np.outer(d, d))
    v = system.vectors
    return np.abs(lap @ v - v * system.values).max(), np.abs(v.T @ v - np.eye(v.shape[1])).max()


def test_pairs_with_multiplicities(spark):
    """Four components: the value 0 four times, and orthonormal vectors."""
    g = complete_graph(spark, 8)
    g = g.disjoint_union(g).disjoint_union(g.disjoint_union(barbell_graph(spark, 5)))
    system = spectrum.compute_eigensystem(g, k=5, dense_vertices=0)
    dense = spectrum.compute_eigensystem(g, k=5)
    assert list(system.values) == pytest.approx(list(dense.values), abs=1e-7)
    assert max(residuals(g, system)) < 1e-5


@pytest.mark.parametrize("kind", list(spectrum.GraphMatrix))
@pytest.mark.parametrize("which", list(spectrum.Which))
def test_both_ends_of_a_block_model(spark, kind, which):
    edges = random_graphs.sbm(spark, 90, 3, 0.6, 0.05).edges.collect()
    g = Graph(spark.createDataFrame([tuple(r) for r in edges], EDGE_SCHEMA).coalesce(2), 90)
    near = spectrum.compute_eigenvalues(g, kind, 2, which)
    far = spectrum.compute_eigensystem(g, kind, 2, which, dense_vertices=0).values
    assert list(far) == pytest.approx(list(near), abs=1e-6 * max(1, np.abs(near).max()))


def test_clusters_and_cuts_off_the_driver(spark):
    edges = random_graphs.sbm(spark, 120, 3, 0.5, 0.02).edges.collect()
    g = Graph(spark.createDataFrame([tuple(r) for r in edges], EDGE_SCHEMA).coalesce(2), 120)
    assert metrics.adjusted_rand_index(random_graphs.sbm_labels(spark, 120, 3), cluster.spectral_cluster(g, 3, dense_vertices=0)).first()[0] == 1
    bell = cluster.cheeger_cut(barbell_graph(spark, 10), dense_vertices=0).filter("label = 1")
    assert {r.id for r in bell.collect()} in ({*range(10)}, {*range(10, 20)})


def test_shapes_are_checked(spark):
    from lattica.operators import matrices

    a = matrices.adjacency(complete_graph(spark, 3))
    vector = lambda *v: spark.createDataFrame(list(enumerate(map(float, v))), "id long, value double")
    assert spectrum.rayleigh_quotient(a, vector(1, 1, 1), 3).first()[0] == pytest.approx(2)
    with pytest.raises(ValueError):
        spectrum.rayleigh_quotient(a, vector(1, 1, 1), 2)
    with pytest.raises(ValueError):
        spectrum.rayleigh_quotient(a, vector(1, 1, 1, 1), 3)


def test_vertices_and_labels_are_checked(spark):
    loop = Graph.from_matrix(spark.createDataFrame([(0, 0, 1.0)], EDGE_SCHEMA))
    assert loop.n == 1 and Graph.from_matrix(spark.createDataFrame([], EDGE_SCHEMA)).n == 0
    labels = lambda *x: spark.createDataFrame(list(enumerate(x)), "id long, label long")
    for f in (metrics.adjusted_rand_index, metrics.mutual_information, metrics.normalised_mutual_information, metrics.contingency_table):
        with pytest.raises(ValueError):
            f(labels(0, 1, 1, 0), labels(0, 1, 1))
        with pytest.raises(ValueError):
            f(labels(0, 1, -1), labels(0, 1, 1))


def test_many_blocks_are_one_plan(spark):
    sizes = [2] * 300
    p = [[1.0 if a == b else (0.5 if b == a + 1 else 0.0) for b in range(300)] for a in range(300)]
    edges = random_graphs.sbm_edges(spark, sizes, p).collect()
    assert sum(r.i // 2 == r.j // 2 for r in edges) == 300 and {r.j // 2 - r.i // 2 for r in edges} == {0, 1}


def test_connectivity_of_a_long_cycle(spark):
    from lattica.operators import traversal

    g = cycle_graph(spark, 3000)
    assert traversal.is_connected(g) and traversal.connected_component(g, 7).count() == 3000
    two = g.disjoint_union(Graph(g.edges.limit(0), 1))
    assert not traversal.is_connected(two) and [r.id for r in traversal.connected_component(two, 3000).collect()] == [3000]
    assert math.isnan(metrics.normalised_mutual_information(*[spark.createDataFrame([(0, 0)], "id long, label long")] * 2).first()[0])
