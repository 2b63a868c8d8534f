import math

import pytest

from lattica.errors import GraphFormatError
from lattica.graph import EDGE_SCHEMA, Graph, barbell_graph, complete_graph, cycle_graph, identity_graph, star_graph
from lattica.operators import cluster, matrices, metrics, spectrum, traversal
from lattica.operators.random_graphs import general_sbm, sbm, sbm_labels

# A triangle with a tail, and the same with loops, in compressed columns.
W4 = ([0, 2, 4, 7, 8], [1, 2, 0, 2, 0, 1, 3, 2], [2, 3.3333, 2, 6, 3.3333, 6, 1, 1])


@pytest.fixture(scope="module")
def w4(spark):
    return Graph.from_csc(spark, *W4)


@pytest.fixture(scope="module")
def w4_loops(spark, w4):
    loops = spark.createDataFrame([(0, 0, 1.0), (2, 2, 2.0), (3, 3, 1.0)], EDGE_SCHEMA)
    return Graph(w4.edges.unionByName(loops), 4)


def degrees(g):
    return {r.id: (round(r.degree, 4), r.degree_unweighted) for r in g.degrees.collect()}


def entries(df, value="value"):
    return {(r["i"], r["j"]): r[value] for r in df.collect()}


def test_degrees(w4, w4_loops):
    assert degrees(w4) == {0: (5.3333, 2), 1: (8.0, 2), 2: (10.3333, 3), 3: (1.0, 1)}
    assert degrees(w4_loops) == {0: (7.3333, 4), 1: (8.0, 2), 2: (14.3333, 5), 3: (3.0, 3)}
    assert w4_loops.number_of_edges() == 7 and w4.number_of_edges() == 4
    assert w4_loops.total_volume() == pytest.approx(32.6666) and w4_loops.average_degree() == pytest.approx(32.6666 / 4)
    assert w4_loops.has_self_loops() and not w4.has_self_loops()


def test_laplacian_is_recognised(w4, w4_loops):
    for g in (w4, w4_loops):
        back = Graph.from_matrix(matrices.laplacian(g).withColumnRenamed("value", "weight"), g.n)
        ours, theirs = entries(back.edges, "weight"), entries(g.edges, "weight")
        assert ours.keys() == theirs.keys() and all(ours[k] == pytest.approx(theirs[k]) for k in ours)


def test_bad_matrices(spark, w4):
    for rows in ([(0, 1, 1.0), (1, 0, 2.0)], [(0, 0, 1.0), (0, 1, -1.0), (1, 0, 1.0)], [(0, 0, 0.5), (0, 1, -1.0), (1, 0, -1.0), (1, 1, 1.0)]):
        with pytest.raises(GraphFormatError):
            Graph.from_matrix(spark.createDataFrame(rows, EDGE_SCHEMA), 2)
    with pytest.raises(ValueError):
        Graph.from_csc(spark, [0, 1], [0, 1], [1.0])
    with pytest.raises(GraphFormatError):
        -1 * w4


def test_normalised_laplacian_with_loops(w4_loops):
    m = entries(matrices.normalised_laplacian(w4_loops))
    assert [m[i, i] for i in range(4)] == pytest.approx([1 - 1 / 7.3333, 1, 1 - 2 / 14.3333, 1 - 1 / 3])


def test_walk_columns_sum_to_one(w4):
    sums = {}
    for (_, j), v in entries(matrices.lazy_random_walk_matrix(w4)).items():
        sums[j] = sums.get(j, 0) + v
    assert all(s == pytest.approx(1) for s in sums.values())


def test_isolated_vertices(spark):
    g = cycle_graph(spark, 8).subgraph([3, 4, 5, 7])
    lap = entries(matrices.laplacian(g))
    assert lap[3, 3] == 0.0 and lap[1, 1] == 2.0
    assert entries(matrices.inverse_degree_matrix(g))[3, 3] == 0.0


def test_mutation(w4):
    g = w4.add_edge(1, 3, 1.5).add_edge(1, 4, 1.0)
    assert g.n == 5 and entries(g.edges, "weight")[3, 1] == 1.5
    g = g.remove_edge(1, 4)
    assert g.n == 5 and (1, 4) not in entries(g.edges, "weight")
    assert entries(w4.add_edge(1, 1, 1.0).edges, "weight")[1, 1] == 2.0
    with pytest.raises(ValueError):
        w4.subgraph([9])


def test_named_graphs(spark):
    assert degrees(star_graph(spark, 5))[0] == (4.0, 4)
    assert entries(matrices.laplacian(identity_graph(spark, 3))) == {(i, i): 1.0 for i in range(3)}
    assert 3 * star_graph(spark, 5) == star_graph(spark, 5) * 3
    assert complete_graph(spark, 4) + cycle_graph(spark, 4) != complete_graph(spark, 4)
    for f in (cycle_graph, complete_graph, barbell_graph, star_graph):
        with pytest.raises(ValueError):
            f(spark, 1)


def test_pagerank_golden(spark):
    c4 = Graph.from_edges(spark.createDataFrame([(0, 1, 0.5), (1, 3, 0.5), (3, 2, 0.5), (2, 0, 0.5)], EDGE_SCHEMA))
    p, r = cluster.approximate_pagerank(c4, {0: 1.0}, 1 / 3, 1 / 8)
    assert p == pytest.approx({0: 41 / 81, 1: 2 / 27, 2: 2 / 27})
    assert r == pytest.approx({0: 5 / 81, 1: 2 / 27 + 5 / 162, 2: 2 / 27 + 5 / 162, 3: 2 / 27})
    state = cluster.bulk_pagerank(c4, spark.createDataFrame([(0, 1.0)], "id long, value double"), 1 / 3, 1 / 8).toPandas()
    assert state.p.sum() + state.r.sum() == pytest.approx(1) and (state.r < 1 / 8).all()
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    assert metrics.conductance(c4, ids(0, 3)).first()[0] == 1.0 and metrics.conductance(c4, ids(1, 3)).first()[0] == 0.5
    assert metrics.conductance(c4, ids()).first()[0] == 0.0


def test_nothing_to_push(spark):
    g = cycle_graph(spark, 6)
    assert cluster.approximate_pagerank(g, {0: 1.0}, 0.5, 5.0)[0] == {}
    with pytest.raises(ValueError):
        cluster.approximate_pagerank(g, {9: 1.0}, 0.5, 0.1)
    with pytest.raises(ValueError):
        cluster.local_cluster(g, 0, 0)


def test_sweep_golden(spark):
    scores = spark.createDataFrame([(0, 0.1), (1, 0.25), (2, 0.2), (3, 0.15), (4, 0.05)], "id long, value double")
    g = barbell_graph(spark, 4)
    assert sorted(r.id for r in cluster.sweep_set(g, scores, g.total_volume()).collect()) == [0, 1, 2, 3]


def test_components(spark):
    g = sbm(spark, 10, 2, 1.0, 0.0)
    assert [r.members for r in traversal.component_lists(g).collect()] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]
    assert not traversal.is_connected(g) and traversal.is_connected(cycle_graph(spark, 7))
    path = Graph.from_edges(spark.range(60).selectExpr("id i", "id + 1 j", "1.0D weight"))
    assert {r.component for r in traversal.connected_components(path).collect()} == {0}


@pytest.mark.parametrize("kind,which", [(k, w) for k in spectrum.GraphMatrix for w in spectrum.Which])
def test_cycle_spectra(spark, kind, which):
    lam = sorted(2 * math.cos(2 * math.pi * j / 20) for j in range(20))
    full = {spectrum.GraphMatrix.ADJACENCY: lam, spectrum.GraphMatrix.LAPLACIAN: sorted(2 - x for x in lam), spectrum.GraphMatrix.NORMALISED_LAPLACIAN: sorted(1 - x / 2 for x in lam)}[kind]
    want = full[:5] if which is spectrum.Which.SMALLEST else full[::-1][:5]
    assert list(spectrum.compute_eigenvalues(cycle_graph(spark, 20), kind, 5, which)) == pytest.approx(want, abs=1e-6)


def test_distributed_eigensolver(spark):
    g = barbell_graph(spark, 20)
    dense = spectrum.compute_eigensystem(g, spectrum.GraphMatrix.NORMALISED_LAPLACIAN, 3, spectrum.Which.SMALLEST)
    spread = spectrum.compute_eigensystem(g, spectrum.GraphMatrix.NORMALISED_LAPLACIAN, 3, spectrum.Which.SMALLEST, dense_vertices=0)
    assert list(spread.values) == pytest.approx(list(dense.values), abs=1e-7)
    with pytest.raises(ValueError):
        spectrum.compute_eigensystem(g, k=g.n)


def test_power_and_rayleigh(spark):
    k3 = complete_graph(spark, 3)
    vector = lambda *v: spark.createDataFrame(list(enumerate(map(float, v))), "id long, value double")
    a, lap = matrices.adjacency(k3), matrices.laplacian(k3)
    assert [spectrum.rayleigh_quotient(a, vector(*v)).first()[0] for v in ((1, 1, 1), (1, 0, -1), (1, 0, 0))] == pytest.approx([2, -1, 0])
    out = {r.id: r.value for r in spectrum.power_method(lap, 3, 2, vector(0, 1, 0)).collect()}
    assert [out[k] for k in range(3)] == pytest.approx([-1 / math.sqrt(6), 2 / math.sqrt(6), -1 / math.sqrt(6)])
    with pytest.raises(ValueError):
        spectrum.rayleigh_quotient(a, vector(0, 0, 0))
    with pytest.raises(ValueError):
        spectrum.power_method(a, 3, -1)


def test_spectral_clusters_of_a_block_model(spark):
    g, truth = sbm(spark, 300, 3, 0.5, 0.02), sbm_labels(spark, 300, 3)
    assert metrics.adjusted_rand_index(truth, cluster.spectral_cluster(g, 3)).first()[0] >= 0.95
    with pytest.raises(ValueError):
        cluster.spectral_cluster(g, 151)


def test_sampled_block_model(spark):
    g = general_sbm(spark, [1000, 100, 10], [[0.4, 0.1, 0.1], [0.1, 0.7, 0.0], [0.1, 0.0, 1.0]])
    assert g.n == 1110 and not g.has_self_loops()
    inside = g.edges.filter("i < j and i < 1000 and j < 1000").selectExpr("sum(weight)").first()[0]
    assert abs(inside / (0.4 * 1000 * 1000 / 2) - 1) < 0.02
    assert sbm(spark, 10, 1, 1.0, 0.0) == complete_graph(spark, 10)
    for bad in ((0, 1, 0.5, 0.5), (10, 6, 0.5, 0.5), (10, 2, 1.5, 0.5)):
        with pytest.raises(ValueError):
            sbm(spark, *bad)


def test_label_metrics(spark):
    table = lambda *v: spark.createDataFrame(list(enumerate(v)), "id long, label long")
    truth, other = table(0, 0, 1, 1, 1, 1, 2, 2, 2, 2), table(0, 1, 0, 1, 1, 2, 2, 2, 2, 2)
    assert metrics.adjusted_rand_index(truth, other).first()[0] == pytest.approx(0.31257344)
    assert metrics.normalised_mutual_information(truth, other).first()[0] == pytest.approx(0.4558585)
    same = table(1, 1, 2, 2, 2, 2, 0, 0, 0, 0)
    assert metrics.adjusted_rand_index(truth, same).first()[0] == pytest.approx(1)
    one = table(0, 0, 0)
    assert math.isnan(metrics.adjusted_rand_index(one, one).first()[0]) and math.isnan(metrics.normalised_mutual_information(one, one).first()[0])
    with pytest.raises(ValueError):
        metrics.check_labels(truth, one)
    with pytest.raises(ValueError):
        metrics.n_choose_2(-1)


def test_cheeger_cut_of_a_complete_graph(spark):
    label = cluster.cheeger_cut(complete_graph(spark, 40))
    assert label.filter("label = 1").count() == 20
