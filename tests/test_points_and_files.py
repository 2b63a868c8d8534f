import math

import numpy as np
import pytest

from lattica.functions.vectors import line_collision_probability, table_collision_probability
from lattica.graph import EDGE_SCHEMA, Graph
from lattica.operators import cluster, kde, lsh, metrics
from lattica.operators.local_graph import StoredGraph
from lattica.sources import adjacency, edgelist, matrix


def moons(n=300, seed=42, noise=0.06):
    rng = np.random.default_rng(seed)
    t = np.pi * rng.random(n // 2)
    top, low = np.c_[np.cos(t), np.sin(t)], np.c_[1 - np.cos(t), 0.5 - np.sin(t)]
    return np.concatenate([top, low]) + rng.normal(0, noise, (n, 2))


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(moons())], "id long, x array<double>")


def densities(df):
    return np.array([r.density for r in df.orderBy("id").collect()])


def test_exact_density(points):
    x = moons()
    want = np.exp(-20 * ((x[:, None] - x[None]) ** 2).sum(2)).mean(1)
    assert densities(kde.exact_kde(points, points, 20.0)) == pytest.approx(want)


def test_sampled_density_is_near(points):
    exact, near = densities(kde.exact_kde(points, points, 20.0)), densities(kde.ckns_kde(points, points, 20.0, eps=0.5))
    assert np.mean(np.abs(near - exact) / exact) <= 0.25


def test_similarity_clusters_moons(spark, points):
    truth = spark.createDataFrame([(i, i // 150) for i in range(300)], "id long, label long")
    full = metrics.adjusted_rand_index(truth, cluster.spectral_cluster(kde.similarity_graph(points, 40.0), 2)).first()[0]
    assert full >= 0.8
    few = kde.approximate_similarity_graph(points, 40.0)
    assert few.n == 300 and few.edges.count() <= 4 * 300


def test_points_of_unlike_size(spark):
    bad = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, x array<double>")
    with pytest.raises(ValueError):
        kde.exact_kde(bad, bad, 1.0)


def test_collision_probability():
    assert line_collision_probability(0.05) == 1 - 0.2 * 0.05
    assert line_collision_probability(-5.6) == line_collision_probability(5.6)
    rng, hits = np.random.default_rng(1), 0
    x, y = np.array([0.0, 1, 1]), np.array([1.0, 0, 0])
    for _ in range(4000):
        a, b = rng.standard_normal(3) / 4, rng.random()
        hits += math.floor(a @ x + b) == math.floor(a @ y + b)
    assert hits / 4000 == pytest.approx(line_collision_probability(math.sqrt(3)), rel=0.2)
    assert 0 < table_collision_probability(5, 10, 2.0) < 1


def test_hash_tables_find_the_point_itself(points):
    table = lsh.E2LSH(3, 4, points, 2)
    found = {(r.query_id, r.id) for r in table.near_neighbours(points.filter("id < 10")).collect()}
    assert {(i, i) for i in range(10)} <= found


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("text", ["# c\n0, 1, 0.5\n1, 2, 1\n2, 0, 0.5\n", "0\t1\t0.5\n1\t2\t1\n\n2\t0\t0.5", "// c\r\n0   1  0.5\r\n1   2\r\n2 0 0.5\r\n"])
def test_edgelists(spark, tmp_path, text):
    g = edgelist.load_edgelist(spark, write(tmp_path, "g", text))
    want = Graph.from_edges(spark.createDataFrame([(0, 1, 0.5), (1, 2, 1.0), (2, 0, 0.5)], EDGE_SCHEMA))
    assert g == want


@pytest.mark.parametrize("line", ["0", "0 1 2 3", "a b", "-1 2"])
def test_bad_edgelists(spark, tmp_path, line):
    with pytest.raises(RuntimeError):
        edgelist.load_edgelist(spark, write(tmp_path, "g", f"0 1\n{line}\n"))
    with pytest.raises(OSError):
        edgelist.load_edgelist(spark, str(tmp_path / "none"))


def test_loops_and_repeated_edges_add_up(spark, tmp_path):
    g = edgelist.load_edgelist(spark, write(tmp_path, "g", "0 1\n1 0\n2 2 3\n"))
    assert {(r.i, r.j): r.weight for r in g.edges.collect()} == {(0, 1): 2.0, (1, 0): 2.0, (2, 2): 6.0}


def test_adjacencylists(spark, tmp_path):
    g = adjacency.load_adjacencylist(spark, write(tmp_path, "a", "# c\n0: 2:0.5   1:0.5\n1: 0:0.5 2\n2: 0:0.5 1\n"))
    assert metrics.conductance(g, spark.createDataFrame([(0,), (1,)], "id long")).first()[0] == pytest.approx(1.5 / 2.5)
    with pytest.raises(RuntimeError):
        adjacency.load_adjacencylist(spark, write(tmp_path, "b", "0: 1\n1 0\n"))
    with pytest.raises(ValueError):
        adjacency.load_adjacencylist(spark, write(tmp_path, "c", "0: 1\n1: 0:2\n"))


def test_stored_graph(spark, tmp_path):
    path = write(tmp_path, "a", "1: 2 3\n2: 1 3\n3: 1 2 3:2\n4: 5 6\n5: 4 6\n6: 4 5\n")
    g = StoredGraph.open_adjacencylist(spark, path)
    assert not g.vertex_exists(0) and g.vertex_exists(6)
    assert g.degree(3) == 6.0 and g.degree_unweighted(3) == 3  # a loop counts once on disk
    with pytest.raises(RuntimeError):
        g.neighbors(9)
    from lattica.operators.traversal import connected_component

    assert sorted(r.id for r in connected_component(g, 5).collect()) == [4, 5, 6]
    assert sorted(r.id for r in cluster.local_cluster_acl(g, 4, 0.5, 0.001).collect()) == [4, 5, 6]


def test_matrices(spark, tmp_path):
    m = matrix.load_matrix(spark, write(tmp_path, "m", "# c\n1 0\n3,5\n2\t6\n"))
    assert [r.x for r in m.orderBy("id").collect()] == [[1, 0], [3, 5], [2, 6]]
    path = str(tmp_path / "saved")
    matrix.save_matrix(m, path)
    assert sorted(map(tuple, matrix.load_matrix(spark, path).collect())) == sorted(map(tuple, m.collect()))
    assert matrix.point(m, 1) == [3, 5]
    with pytest.raises(RuntimeError):
        matrix.load_matrix(spark, write(tmp_path, "r", "1 2\n3\n"))


def test_parquet_keeps_loops_and_isolated_vertices(spark, tmp_path):
    g = Graph(spark.createDataFrame([(1, 1, 2.0)], EDGE_SCHEMA), 5)
    edgelist.save_parquet(g, str(tmp_path / "p"))
    assert edgelist.load_parquet(spark, str(tmp_path / "p")) == g


def test_command_line(spark, tmp_path, capsys):
    from lattica import cli

    assert cli.main([]) != 0 and cli.main(["sbm", "x"]) != 0
    source = write(tmp_path, "g", "0 1\n1 2\n")
    assert cli.main(["edge2adj", source, str(tmp_path / "adj")]) == 0 and cli.main(["adj2edge", str(tmp_path / "adj"), str(tmp_path / "edges")]) == 0
    assert edgelist.load_edgelist(spark, str(tmp_path / "edges")).number_of_edges() == 2
    assert cli.main(["sbm", str(tmp_path / "s"), "20", "2", "0.9", "0.1"]) == 0
