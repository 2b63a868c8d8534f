"""Compressed columns as tables, stretches of numbers, printed vectors, expected degrees, and stored graphs by filter."""

import io

import numpy as np
import pytest
from test_graph import W4
from test_points_and_files import moons

from lattica import graph
from lattica.graph import Graph
from lattica.operators import blocks, cluster, kde, local_graph, matrices, random_graphs
from lattica.sources import edgelist


def test_compressed_column_tables(spark):
    g = Graph.from_csc(spark, *W4)
    starts, entries = matrices.compressed_column_tables(matrices.adjacency(g), 4)
    assert [r.start for r in starts.orderBy("j").collect()] == W4[0]
    assert [(r.i, r.value) for r in entries.orderBy("place").collect()] == list(zip(W4[1], W4[2]))


def test_stretches(spark, monkeypatch):
    monkeypatch.setattr(graph, "STRETCH", 7)
    rows = spark.createDataFrame([(0, 0, 20), (1, 5, 5), (2, 3, 4)], "id long, a long, b long")
    for spread in (False, True):
        out = graph.ranges(rows, rows.a, rows.b, "k", spread=spread).collect()
        assert sorted((r.id, r.k) for r in out) == [(0, k) for k in range(20)] + [(2, 3)]
    assert graph.complete_graph(spark, 9).number_of_edges() == 36


def test_printed_vectors(spark):
    out = io.StringIO()
    matrices.print_vector(spark.createDataFrame([(1, 2.5), (0, -1.0)], "id long, value double"), out)
    assert out.getvalue() == "-1.0\n2.5\n"


def test_expected_degrees(spark):
    out = random_graphs.expected_neighbours(spark, [2, 1], [[0.5, 1.0], [1.0, 0.0]]).orderBy("id").collect()
    assert [r.expected for r in out] == [2.0, 2.0, 2.0]


def test_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 9)
    x = moons(40)
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    got = np.zeros((40, 40))
    rows = kde.similarity_graph(points, 2.0).edges.collect()
    for r in rows:
        got[r.i, r.j] += r.weight
    assert len(rows) == 1600 and got == pytest.approx(np.exp(-2 * ((x[:, None] - x[None]) ** 2).sum(2)))


@pytest.mark.parametrize("filtered", [5000, 0])
def test_stored_graphs_are_read_by_filter(spark, tmp_path, monkeypatch, filtered):
    monkeypatch.setattr(local_graph, "FILTERED", filtered)
    edgelist.save_parquet(graph.barbell_graph(spark, 6), str(tmp_path / "g"))
    stored = local_graph.StoredGraph.open_parquet(spark, str(tmp_path / "g"))
    assert sorted(r.id for r in cluster.local_cluster_acl(stored, 0, 0.8, 0.0001).collect()) == list(range(6))
    if filtered:
        plan = stored.entries_of([1, 2])._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual(i,1)" in plan


def test_staged_tables_are_cleared(spark, tmp_path, monkeypatch):
    from lattica import work

    monkeypatch.setattr(work, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    assert work.stage(spark.range(3), "some").count() == 3
    assert list(tmp_path.rglob("*.parquet"))
    work.clear(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_only_local_sessions_go_without_a_shared_folder():
    from types import SimpleNamespace

    from lattica import work

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId=f"test-{master}"))
    with pytest.raises(RuntimeError):
        work.shared_folder(session("yarn"))
    assert work.shared_folder(session("local[2]")) == work.shared_folder(session("local[2]"))
