"""The registered queries of the graph and vector operators, and their SQL in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .graph import Graph, asymmetric_entries, barbell_graph, complete_graph, cycle_graph, identity_graph, star_graph
from .operators import cluster, kde, local_graph, lsh, matrices, metrics, random_graphs, spectrum, traversal
from .operators.running import running_sums
from .plans import datasets
from .sources import adjacency, edgelist, matrix, text
from .work import shared_path, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def rounded_fast(df: DataFrame, column: str) -> DataFrame:
    """As `rounded`, of numbers from 0 to 1, by whole millionths: Spark's round makes a decimal of each number, which costs more than all else where rows are pairs."""
    return df.withColumn(column, F.floor(F.col(column) * 1e6 + 0.5) / 1e6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of fractions depend on their order; six digits don't. Adding 0 makes -0 a 0."""
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})


# Graphs in SQL: e (i, j, weight) has both directions, n (n) one row, d (id, degree, unweighted) every vertex.
_DEGREES = """
 d AS (SELECT v.id, coalesce(sum(CASE WHEN e.i = e.j THEN 2 * weight ELSE weight END), 0.0)::DOUBLE AS degree,
         (count(e.i) + count(e.i) FILTER (WHERE e.i = e.j))::BIGINT AS unweighted
       FROM (SELECT unnest(range((SELECT n FROM n)))::BIGINT AS id) v LEFT JOIN e ON e.i = v.id GROUP BY v.id)"""
_BOTH = " e AS (SELECT i, j, weight FROM h UNION ALL SELECT j, i, weight FROM h),"
_PS = f"""
 c AS (SELECT (SELECT count(*) FROM part) AS np, (SELECT count(*) FROM supplier) AS ns), n AS (SELECT np + ns AS n FROM c),
 h AS (SELECT l_partkey AS i, np + l_suppkey AS j, sum(l_quantity) AS weight FROM lineitem, c GROUP BY 1, 2),{_BOTH}{_DEGREES}"""
_GEO = f"""
 c AS (SELECT (SELECT count(*) FROM region) AS nr, (SELECT count(*) FROM nation) AS nn), n AS (SELECT nr + nn AS n FROM c),
 h AS (SELECT n_regionkey::BIGINT AS i, nr + n_nationkey AS j, 1.0::DOUBLE AS weight FROM nation, c),{_BOTH}{_DEGREES}"""
_EV = f"""
 ev AS (SELECT user_id, event_type, count(*)::DOUBLE AS weight FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2),
 us AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i FROM (SELECT DISTINCT user_id FROM ev)),
 ty AS (SELECT event_type, (SELECT count(*) FROM us) + row_number() OVER (ORDER BY event_type) - 1 AS j FROM (SELECT DISTINCT event_type FROM ev)),
 n AS (SELECT (SELECT count(*) FROM us) + (SELECT count(*) FROM ty) AS n),
 h AS (SELECT i, j, weight FROM ev JOIN us USING (user_id) JOIN ty USING (event_type)),{_BOTH}{_DEGREES}"""


def graph_sql(body: str, graph: str = _PS, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{graph} {body}"


ps, geo, ev = datasets.part_supplier, datasets.nation_region, datasets.user_event

# aggregates and lookups


@query(graph_sql("SELECT id, degree FROM d"))
def degree(spark, sf_dir):
    return ps(spark, sf_dir).degrees.select("id", "degree")


@query(graph_sql("SELECT id, unweighted AS degree_unweighted FROM d"))
def degree_unweighted(spark, sf_dir):
    return ps(spark, sf_dir).degrees.select("id", "degree_unweighted")


@query(graph_sql("SELECT sum(degree) AS total_volume FROM d"))
def total_volume(spark, sf_dir):
    return ps(spark, sf_dir).totals().select("total_volume")


@query(graph_sql("SELECT sum(degree) / (SELECT n FROM n) AS average_degree FROM d"))
def average_degree(spark, sf_dir):
    return ps(spark, sf_dir).totals().select("average_degree")


@query(graph_sql("SELECT n::BIGINT AS n_vertices FROM n"))
def num_vertices(spark, sf_dir):
    return ps(spark, sf_dir).totals().select("n_vertices")


@query(graph_sql("SELECT count(*) AS n_edges FROM e WHERE i <= j"))
def num_edges(spark, sf_dir):
    return ps(spark, sf_dir).totals().select("n_edges")


@query(graph_sql("SELECT count(*) FILTER (WHERE i = j) > 0 AS has_self_loops FROM e"))
def has_self_loops(spark, sf_dir):
    return ps(spark, sf_dir).totals().select("has_self_loops")


@query(graph_sql("SELECT i AS v1, j AS v2, weight FROM e WHERE i = 7"))
def neighbors(spark, sf_dir):
    return ps(spark, sf_dir).neighbors(7)


@query(graph_sql("SELECT j AS v2 FROM e WHERE i = 7"))
def neighbors_unweighted(spark, sf_dir):
    return ps(spark, sf_dir).neighbors_unweighted(7)


_ASKED = [(0, 5), (1, 3), (2, 5), (3, 17), (4, 0)]


@query(graph_sql(f"SELECT pos::BIGINT AS pos, a.id::BIGINT AS id, degree, unweighted AS degree_unweighted FROM (VALUES {str(_ASKED)[1:-1]}) a(pos, id) JOIN d ON d.id = a.id"))
def bulk_degrees(spark, sf_dir):
    return ps(spark, sf_dir).degrees_of(spark.createDataFrame(_ASKED, "pos long, id long"))


@query(graph_sql("SELECT v::BIGINT AS v, v >= 0 AND v < (SELECT n FROM n) AS found FROM (VALUES (-1), (0), (7), (1000000000)) t(v)"))
def vertex_exists(spark, sf_dir):
    g = ps(spark, sf_dir)
    return spark.createDataFrame([(v, g.vertex_exists(v)) for v in (-1, 0, 7, 1_000_000_000)], "v long, found boolean")


@query(graph_sql("SELECT v::BIGINT AS v, EXISTS (SELECT 1 FROM e WHERE e.i = v) AS found FROM (VALUES (-1), (0), (7), (1000000000)) t(v)"))
def stored_vertex_exists(spark, sf_dir):
    """Of a graph that lies in Parquet, where a vertex is one with a row."""
    path = shared_path(spark, "stored-graph")
    edgelist.save_parquet(ps(spark, sf_dir), path)
    stored = local_graph.StoredGraph.open_parquet(spark, path)
    return spark.createDataFrame([(v, stored.vertex_exists(v)) for v in (-1, 0, 7, 1_000_000_000)], "v long, found boolean")


@query(graph_sql("SELECT i, j, weight FROM e WHERE i < 20"))
def stored_neighbors(spark, sf_dir):
    """Neighbours of a frontier of a graph that lies in Parquet."""
    path = shared_path(spark, "stored-graph")
    edgelist.save_parquet(ps(spark, sf_dir), path)
    return local_graph.StoredGraph.open_parquet(spark, path).neighbors_of(spark.range(20))


@query(graph_sql(f"SELECT pos::BIGINT AS pos, a.id::BIGINT AS id, degree, (SELECT count(*) FROM e WHERE e.i = a.id)::BIGINT AS degree_unweighted FROM (VALUES {str(_ASKED)[1:-1]}) a(pos, id) JOIN d ON d.id = a.id"))
def stored_degrees(spark, sf_dir):
    stored = local_graph.StoredGraph(spark, ps(spark, sf_dir).edges)
    return stored.degrees_of(spark.createDataFrame(_ASKED, "pos long, id long"))


# matrices


def _matrix_query(name: str, f, sql: str, graph=geo, graph_text=_GEO):
    query(graph_sql(sql, graph_text), name)(lambda spark, sf_dir: rounded(f(graph(spark, sf_dir)), "value"))


_R = "round({}, 6) + 0.0"
_SUMMED = " , m AS ({}) SELECT i, j, round(sum(value), 6) + 0.0 AS value FROM m GROUP BY i, j"
_ROOTS = "weight / (sqrt(a.degree) * sqrt(b.degree)) AS value FROM e JOIN d a ON a.id = e.i JOIN d b ON b.id = e.j"
_matrix_query("adjacency", matrices.adjacency, "SELECT i, j, weight AS value FROM e", ps, _PS)
_matrix_query("degree_matrix", matrices.degree_matrix, "SELECT id AS i, id AS j, degree AS value FROM d", ps, _PS)
_matrix_query("inverse_degree_matrix", matrices.inverse_degree_matrix, "SELECT id AS i, id AS j, round(CASE WHEN degree = 0 THEN 0 ELSE 1 / degree END, 6) + 0.0 AS value FROM d", ps, _PS)
_matrix_query("laplacian", matrices.laplacian, _SUMMED.format("SELECT id AS i, id AS j, degree AS value FROM d UNION ALL SELECT i, j, -weight FROM e"), ps, _PS)
_matrix_query("signless_laplacian", matrices.signless_laplacian, _SUMMED.format("SELECT id AS i, id AS j, degree AS value FROM d UNION ALL SELECT i, j, weight FROM e"), ps, _PS)
_matrix_query("normalised_laplacian", matrices.normalised_laplacian, _SUMMED.format(f"SELECT id AS i, id AS j, 1.0::DOUBLE AS value FROM d UNION ALL SELECT i, j, -{_ROOTS}"), ps, _PS)
_matrix_query("normalised_signless_laplacian", matrices.normalised_signless_laplacian, _SUMMED.format(f"SELECT id AS i, id AS j, 1.0::DOUBLE AS value FROM d UNION ALL SELECT i, j, {_ROOTS}"), ps, _PS)
_matrix_query("lazy_random_walk", matrices.lazy_random_walk_matrix, _SUMMED.format("SELECT id AS i, id AS j, 0.5::DOUBLE AS value FROM d UNION ALL SELECT i, j, weight / (2 * degree) FROM e JOIN d ON d.id = e.j"), ps, _PS)


@query(graph_sql("SELECT v.id, coalesce(x, 0.0)::DOUBLE AS value FROM (SELECT unnest(range((SELECT n FROM n)))::BIGINT AS id) v LEFT JOIN (SELECT id, degree AS x FROM d WHERE id % 3 = 0) s ON s.id = v.id", _GEO))
def sparse_to_dense(spark, sf_dir):
    g = geo(spark, sf_dir)
    return matrices.dense_vector(g.degrees.filter("id % 3 = 0").select("id", F.col("degree").alias("value")), g.n)


@query(graph_sql("SELECT coalesce(a.id, b.id) AS id, coalesce(a.degree, 0) + coalesce(b.degree, 0) AS value FROM (SELECT * FROM d WHERE id % 2 = 0) a FULL JOIN (SELECT * FROM d WHERE id < 12) b ON a.id = b.id", _GEO))
def add_vectors(spark, sf_dir):
    d = geo(spark, sf_dir).degrees.select("id", F.col("degree").alias("value"))
    return matrices.add_vectors(d.filter("id % 2 = 0"), d.filter("id < 12"))


@query(graph_sql(", c2 AS (SELECT j, count(*) AS size FROM e GROUP BY j) SELECT v.j, coalesce((SELECT sum(size) FROM c2 WHERE c2.j < v.j), 0)::BIGINT AS start FROM (SELECT unnest(range((SELECT n FROM n) + 1))::BIGINT AS j) v"))
def compressed_column_starts(spark, sf_dir):
    g = ps(spark, sf_dir)
    return matrices.compressed_column_tables(matrices.adjacency(g), g.n)[0]


@query(graph_sql("SELECT row_number() OVER (ORDER BY j, i) - 1 AS place, i, weight AS value FROM e"))
def compressed_column_entries(spark, sf_dir):
    g = ps(spark, sf_dir)
    return matrices.compressed_column_tables(matrices.adjacency(g), g.n)[1]


@query("SELECT id, CASE WHEN id < 4 THEN 1.9 ELSE 1.2 END::DOUBLE AS expected FROM (SELECT unnest(range(7)) AS id)")
def expected_neighbours(spark, sf_dir):
    return rounded(random_graphs.expected_neighbours(spark, [4, 3], [[0.4, 0.1], [0.15, 0.2]]), "expected")


@query(graph_sql("SELECT j AS col_, count(*) AS n, sum(weight) AS total FROM e GROUP BY j", _GEO))
def compressed_columns(spark, sf_dir):
    g = geo(spark, sf_dir)
    starts, rows, values = matrices.compressed_columns(matrices.adjacency(g), g.n)
    back = Graph.from_csc(spark, starts, rows, values)
    return back.edges.groupBy(F.col("j").alias("col_")).agg(F.count("*").alias("n"), F.sum("weight").alias("total"))


# construction and algebra


@query(graph_sql("SELECT i, j, weight FROM e"))
def from_laplacian(spark, sf_dir):
    g = ps(spark, sf_dir)
    return Graph.from_matrix(matrices.laplacian(g).withColumnRenamed("value", "weight"), g.n).edges


@query(graph_sql("SELECT i, j, weight FROM h x WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.i = x.j AND y.j = x.i AND y.weight = x.weight)"))
def symmetric_check(spark, sf_dir):
    """Entries of one direction only, which all lack their mirror image."""
    return asymmetric_entries(ps(spark, sf_dir).edges.filter("i < j"))


@query(graph_sql("SELECT i, j, sum(weight) AS weight FROM (SELECT * FROM e UNION ALL SELECT * FROM (VALUES (0, 6, 1.5), (6, 0, 1.5), (2, 2, 1.0), (2, 2, 1.0), (3, 40, 2.0), (40, 3, 2.0)) t(i, j, weight)) GROUP BY i, j", _GEO))
def add_edge(spark, sf_dir):
    return geo(spark, sf_dir).add_edge(0, 6, 1.5).add_edge(2, 2, 1.0).add_edge(3, 40, 2.0).edges


@query(graph_sql("SELECT i, j, weight FROM e WHERE NOT (i = 0 AND j = 5 OR i = 5 AND j = 0)", _GEO))
def remove_edge(spark, sf_dir):
    return geo(spark, sf_dir).remove_edge(0, 5).edges


_CHOSEN = [3, 1, 12, 9, 3, 20, 6]
_CHOSEN_SQL = ", ".join(str((v, k)) for k, v in enumerate(dict.fromkeys(_CHOSEN)))


@query(graph_sql(f", s AS (SELECT * FROM (VALUES {_CHOSEN_SQL}) t(v, k)) SELECT a.k::BIGINT AS i, b.k::BIGINT AS j, weight FROM e JOIN s a ON a.v = e.i JOIN s b ON b.v = e.j", _GEO))
def subgraph(spark, sf_dir):
    return geo(spark, sf_dir).subgraph(_CHOSEN).edges


@query(graph_sql("SELECT i, j, weight FROM e UNION ALL SELECT i + n, j + n, weight FROM e, n", _GEO))
def disjoint_union(spark, sf_dir):
    g = geo(spark, sf_dir)
    return g.disjoint_union(g).edges


@query(graph_sql(", z AS (SELECT * FROM e UNION ALL SELECT id, (id + 1) % n, 1.0 FROM d, n UNION ALL SELECT (id + 1) % n, id, 1.0 FROM d, n) SELECT i, j, sum(weight) AS weight FROM z GROUP BY i, j", _GEO))
def graph_sum(spark, sf_dir):
    g = geo(spark, sf_dir)
    return (g + cycle_graph(spark, g.n)).edges


@query(graph_sql("SELECT i, j, weight * 3 AS weight FROM e", _EV))
def graph_scale(spark, sf_dir):
    return (3 * ev(spark, sf_dir)).edges


@query("SELECT true AS same, false AS same_as_scaled")
def graph_equal(spark, sf_dir):
    g = ev(spark, sf_dir)
    return spark.createDataFrame([(g == Graph(g.edges, g.n), g == 2 * g)], "same boolean, same_as_scaled boolean")


_ROWS = "(SELECT unnest(range({})) AS i) a, (SELECT unnest(range({})) AS j) b"
_edge = lambda g: g.edges


@query(f"SELECT i, j, 1.0::DOUBLE AS weight FROM {_ROWS.format(20, 20)} WHERE (i + 1) % 20 = j OR (j + 1) % 20 = i")
def cycle(spark, sf_dir):
    return cycle_graph(spark, 20).edges


@query(f"SELECT i, j, 1.0::DOUBLE AS weight FROM {_ROWS.format(30, 30)} WHERE i <> j")
def complete(spark, sf_dir):
    return complete_graph(spark, 30).edges


@query(f"SELECT i, j, 1.0::DOUBLE AS weight FROM {_ROWS.format(16, 16)} WHERE i <> j AND (i // 8 = j // 8 OR least(i, j) = 7 AND greatest(i, j) = 8)")
def barbell(spark, sf_dir):
    return barbell_graph(spark, 8).edges


@query(f"SELECT i, j, 1.0::DOUBLE AS weight FROM {_ROWS.format(12, 12)} WHERE (i = 0) <> (j = 0)")
def star(spark, sf_dir):
    return star_graph(spark, 12).edges


@query("SELECT i, i AS j, 1.0::DOUBLE AS weight FROM (SELECT unnest(range(9)) AS i)")
def identity(spark, sf_dir):
    return identity_graph(spark, 9).edges


# text formats: written, read back


@query(graph_sql("SELECT i, j, weight FROM e"))
def edgelist_round_trip(spark, sf_dir):
    path = shared_path(spark, "edgelist")
    edgelist.save_edgelist(ps(spark, sf_dir), path)
    return edgelist.load_edgelist(spark, path).edges


@query(graph_sql("SELECT count(*) AS n_lines, max(greatest(i, j)) + 1 AS n_vertices FROM h"))
def edgelist_statistics(spark, sf_dir):
    path = shared_path(spark, "edgelist")
    edgelist.save_edgelist(ps(spark, sf_dir), path)
    return edgelist.edgelist_stats(spark, path)


@query(graph_sql("SELECT i, j, 2 * weight AS weight FROM e", _GEO))
def edgelist_duplicated(spark, sf_dir):
    """An edge list with every edge in both directions loads with twice the weights."""
    path, twice = shared_path(spark, "edgelist"), shared_path(spark, "edgelist")
    edgelist.save_edgelist(geo(spark, sf_dir), path)
    edgelist.duplicate_edges(spark, path, twice)
    return edgelist.load_edgelist(spark, twice).edges


@query(graph_sql("SELECT i AS u, j AS v, weight FROM h", _GEO))
def edgelist_sorted(spark, sf_dir):
    path, done = shared_path(spark, "edgelist"), shared_path(spark, "edgelist")
    edgelist.save_edgelist(geo(spark, sf_dir), path)
    edgelist.sort_edgelist(spark, path, done)
    return edgelist.read_edges(spark, done)


@query(graph_sql("SELECT d.id || ':' || coalesce(' ' || (SELECT string_agg(j || ':' || weight::BIGINT, ' ' ORDER BY j) FROM e WHERE e.i = d.id), '') AS line FROM d", _GEO))
def adjacencylist_lines(spark, sf_dir):
    path = shared_path(spark, "adjacencylist")
    adjacency.save_adjacencylist(geo(spark, sf_dir), path)
    return text.content_lines(spark, path).select(F.rtrim("value").alias("line"))


@query(graph_sql("SELECT i, j, weight FROM e"))
def adjacencylist_round_trip(spark, sf_dir):
    path = shared_path(spark, "adjacencylist")
    adjacency.save_adjacencylist(ps(spark, sf_dir), path)
    return adjacency.load_adjacencylist(spark, path).edges


@query(graph_sql("SELECT i, j, weight FROM e"))
def format_conversions(spark, sf_dir):
    """Edge list to adjacency list and back."""
    a, b, c = (shared_path(spark, "converted") for _ in range(3))
    edgelist.save_edgelist(ps(spark, sf_dir), a)
    adjacency.edgelist_to_adjacencylist(spark, a, b)
    adjacency.adjacencylist_to_edgelist(spark, b, c)
    return edgelist.load_edgelist(spark, c).edges


@query("SELECT vec_id AS id, k::INTEGER AS place, embedding[k + 1]::DOUBLE AS value FROM embeddings, unnest(range(len(embedding))) AS u(k)")
def matrix_round_trip(spark, sf_dir):
    """The text has no ids, so rows are numbered, and get their ids back by their numbers. A row without numbers has no line."""
    path = shared_path(spark, "matrix")
    rows = running_sums(datasets.embedding_points(spark, sf_dir).filter("size(x) > 0").withColumnRenamed("id", "vec_id"), [F.asc("vec_id")], [])
    rows = stage(rows.select((F.col("rank") - 1).alias("id"), "vec_id", "x"), "matrix-rows")
    matrix.save_matrix(rows.select("id", "x"), path)
    read = matrix.load_matrix(spark, path).join(rows.select("id", "vec_id"), "id")
    return read.select(F.col("vec_id").alias("id"), F.posexplode("x").alias("place", "value"))


# traversal

_REACH = ", r(id, c) AS (SELECT id, id FROM d UNION SELECT r.id, e.j FROM r JOIN e ON e.i = r.c)"


@query(graph_sql(f"{_REACH} SELECT id, min(c) AS component FROM r GROUP BY id", _GEO, recursive=True))
def connected_components(spark, sf_dir):
    return traversal.connected_components(geo(spark, sf_dir))


@query(graph_sql(f"{_REACH}, m AS (SELECT id, min(c) AS component FROM r GROUP BY id) SELECT component, array_to_string(list(id ORDER BY id), ',') AS members FROM m GROUP BY component", _GEO, recursive=True))
def component_lists(spark, sf_dir):
    return traversal.component_lists(geo(spark, sf_dir)).select("component", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(graph_sql(", r(id) AS (SELECT 3::BIGINT UNION SELECT e.j FROM r JOIN e ON e.i = r.id) SELECT id FROM r", _GEO, recursive=True))
def connected_component(spark, sf_dir):
    return traversal.connected_component(geo(spark, sf_dir), 3)


@query(graph_sql(f"{_REACH} SELECT count(DISTINCT c) FILTER (WHERE id = 0) = (SELECT n FROM n) AS connected FROM r", _GEO, recursive=True))
def is_connected(spark, sf_dir):
    return spark.createDataFrame([(traversal.is_connected(geo(spark, sf_dir)),)], "connected boolean")


# the least label spreads until no neighbour has a lesser one; a round sees the vertices that the one before has changed
@query(graph_sql(", q(id, component) USING KEY (id) AS (SELECT id, id FROM d UNION SELECT e.j, min(q.component) FROM q JOIN e ON e.i = q.id JOIN recurring.q r ON r.id = e.j WHERE q.component < r.component GROUP BY e.j) SELECT id, component FROM q", recursive=True))
def components_part_supplier(spark, sf_dir):
    return traversal.connected_components(ps(spark, sf_dir))


# sweeps and conductance

_SCORE = "(id * 7919) % 1009"
_PROFILE = f""",
 s AS (SELECT id, degree, ({_SCORE})::DOUBLE AS v FROM d),
 b AS (SELECT e.i AS id, sum(weight) AS back FROM e JOIN s x ON x.id = e.i JOIN s y ON y.id = e.j WHERE y.v > x.v OR y.v = x.v AND y.id <= x.id GROUP BY e.i),
 p AS (SELECT row_number() OVER w AS rank, id, sum(degree - 2 * coalesce(back, 0)) OVER w AS cut, sum(degree) OVER w AS volume
       FROM s LEFT JOIN b USING (id) WINDOW w AS (ORDER BY v DESC, id ROWS UNBOUNDED PRECEDING))"""


def _scores(g: Graph) -> DataFrame:
    return g.vertices.select("id", F.expr(f"cast({_SCORE} as double)").alias("value"))


@query(graph_sql(f"{_PROFILE} SELECT * FROM p"))
def sweep_profile(spark, sf_dir):
    g = ps(spark, sf_dir)
    return cluster.sweep_profile(g, _scores(g))


@query(graph_sql(f"""{_PROFILE}, t AS (SELECT sum(degree) AS total FROM d),
 b2 AS (SELECT rank FROM p, t WHERE least(volume, total - volume) > 0 AND cut / least(volume, total - volume) < 2 ORDER BY cut / least(volume, total - volume), rank LIMIT 1)
 SELECT id FROM p WHERE rank <= (SELECT rank FROM b2)"""))
def sweep_set(spark, sf_dir):
    g = ps(spark, sf_dir)
    return cluster.sweep_set(g, _scores(g), g.total_volume())


@query(graph_sql("SELECT round(coalesce(sum(weight) FILTER (WHERE j % 5 <> 0), 0) / sum(weight), 6) AS conductance FROM e WHERE i % 5 = 0"))
def conductance(spark, sf_dir):
    g = ps(spark, sf_dir)
    return rounded(metrics.conductance(g, g.vertices.filter("id % 5 = 0")), "conductance")


@query("SELECT unnest([0, 1, 5, 6])::BIGINT AS id")
def symmetric_difference(spark, sf_dir):
    s, t = (spark.createDataFrame([(v,) for v in x], "id long") for x in ((0, 3, 2, 6), (3, 1, 5, 2)))
    return metrics.symmetric_difference(s, t)


@query("SELECT coalesce(p, s) AS id FROM (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_quantity > 49) a FULL JOIN (SELECT DISTINCT l_partkey AS s FROM lineitem WHERE l_discount > 0.09) b ON p = s WHERE p IS NULL OR s IS NULL")
def symmetric_difference_parts(spark, sf_dir):
    """Parts of large orders or of large discounts, but not both."""
    sold = datasets.read(spark, sf_dir, "lineitem")
    s, t = (sold.filter(f).select(F.col("l_partkey").alias("id")) for f in ("l_quantity > 49", "l_discount > 0.09"))
    return metrics.symmetric_difference(s, t)


# random walks and products

_PUSH = """,
 p{k} AS (SELECT id, p + 0.2 * q AS p, r - q + 0.4 * q + coalesce(got, 0) AS r, degree FROM
   (SELECT s.*, CASE WHEN degree > 0 AND r >= 0.001 * degree THEN r ELSE 0 END AS q FROM p{b} s) z LEFT JOIN
   (SELECT e.j AS id, sum(0.8 * q * weight / (2 * degree)) AS got FROM
      (SELECT s.*, CASE WHEN degree > 0 AND r >= 0.001 * degree THEN r ELSE 0 END AS q FROM p{b} s) y JOIN e ON e.i = y.id WHERE q > 0 GROUP BY e.j) g USING (id))"""


@query(graph_sql(", p0 AS (SELECT id, 0.0::DOUBLE AS p, CASE WHEN id = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS r, degree FROM d)" + "".join(_PUSH.format(k=k, b=k - 1) for k in (1, 2, 3)) + " SELECT id, round(p, 6) + 0.0 AS p, round(r, 6) + 0.0 AS r FROM p3 WHERE p > 0 OR r > 0", _GEO))
def ppr_push_rounds(spark, sf_dir):
    g = geo(spark, sf_dir)
    state = spark.createDataFrame([(0, 0.0, 1.0)], "id long, p double, r double")
    for _ in range(3):
        state = cluster.pagerank_round(g, state, 0.2, 0.001)
    return rounded(state.filter("p > 0 or r > 0"), "p", "r")


_STEP = ", y{k} AS (SELECT i AS id, sum(weight * x) AS x FROM e JOIN v{b} ON v{b}.id = e.j GROUP BY i), v{k} AS (SELECT id, x / sqrt((SELECT sum(x * x) FROM y{k})) AS x FROM y{k})"


@query(graph_sql(", v0 AS (SELECT id, 1.0::DOUBLE + id % 3 AS x FROM d)" + "".join(_STEP.format(k=k, b=k - 1) for k in (1, 2, 3)) + " SELECT id, round(x, 6) + 0.0 AS value FROM v3"))
def power_method_steps(spark, sf_dir):
    g = ps(spark, sf_dir)
    start = g.vertices.select("id", (F.lit(1.0) + F.col("id") % 3).alias("value"))
    return rounded(spectrum.power_method(matrices.adjacency(g), g.n, 3, start), "value")


@query(graph_sql(", v AS (SELECT id, 1.0::DOUBLE + id % 3 AS x FROM d) SELECT round((SELECT sum(weight * a.x * b.x) FROM e JOIN v a ON a.id = e.i JOIN v b ON b.id = e.j) / (SELECT sum(x * x) FROM v), 6) AS quotient"))
def rayleigh_quotient(spark, sf_dir):
    g = ps(spark, sf_dir)
    return rounded(spectrum.rayleigh_quotient(matrices.adjacency(g), g.vertices.select("id", (F.lit(1.0) + F.col("id") % 3).alias("value"))), "quotient")


# cluster quality

_CELLS = "SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2"


@query("SELECT quality::BIGINT AS truth, toxic::BIGINT AS label, count(*) AS n FROM labels GROUP BY 1, 2")
def contingency(spark, sf_dir):
    return metrics.contingency_table(*datasets.label_pair(spark, sf_dir))


@query("SELECT quality::BIGINT AS label, count(*) AS n FROM labels GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return metrics.cluster_sizes(datasets.label_pair(spark, sf_dir)[0])


@query("SELECT round(sum(p * log2(1 / p)), 6) AS entropy FROM (SELECT count(*) / (SELECT count(*) FROM labels)::DOUBLE AS p FROM labels GROUP BY quality)")
def entropy(spark, sf_dir):
    return rounded(metrics.entropy(datasets.label_pair(spark, sf_dir)[0]), "entropy")


_MI = f"""WITH c AS ({_CELLS}), t AS (SELECT sum(n)::DOUBLE AS n FROM c), a AS (SELECT a, sum(n)::DOUBLE AS n FROM c GROUP BY a), b AS (SELECT b, sum(n)::DOUBLE AS n FROM c GROUP BY b),
 mi AS (SELECT sum(c.n / t.n * log2(t.n * c.n / (a.n * b.n))) AS mi FROM c JOIN a USING (a) JOIN b USING (b), t),
 h AS (SELECT (SELECT sum(a.n / t.n * log2(t.n / a.n)) FROM a, t) + (SELECT sum(b.n / t.n * log2(t.n / b.n)) FROM b, t) AS h)"""


@query(f"{_MI} SELECT round(mi, 6) AS mutual_information FROM mi")
def mutual_information(spark, sf_dir):
    return rounded(metrics.mutual_information(*datasets.label_pair(spark, sf_dir)), "mutual_information")


@query(f"{_MI} SELECT round(mi / (h / 2), 6) AS nmi FROM mi, h")
def nmi(spark, sf_dir):
    return rounded(metrics.normalised_mutual_information(*datasets.label_pair(spark, sf_dir)), "nmi")


@query(f"""WITH c AS ({_CELLS}), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS x, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS a,
 (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS b, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t)
 SELECT round((x - a * b / t) / ((a + b) / 2 - a * b / t), 6) AS ari FROM s""")
def ari(spark, sf_dir):
    return rounded(metrics.adjusted_rand_index(*datasets.label_pair(spark, sf_dir)), "ari")


# kernels and points

_D2 = "list_sum(list_transform(list_zip({}, {}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_PAIR = _D2.format("a.embedding", "b.embedding")


@query(f"SELECT a.vec_id AS i, b.vec_id AS j, round({_PAIR}, 6) AS squared, round(CASE WHEN {_PAIR} > 2 THEN -1 ELSE {_PAIR} END, 6) AS at_most, round(exp(-1.2 * {_PAIR}), 6) AS kernel FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def gaussian_kernel(spark, sf_dir):
    x = datasets.embedding_points(spark, sf_dir)
    pairs = x.toDF("i", "u").withColumn("j", F.col("i") + 1).join(x.toDF("j", "v"), "j")
    d = vectors.squared_distance(F.col("u"), F.col("v"))
    out = pairs.select("i", "j", d.alias("squared"), vectors.squared_distance_at_most(F.col("u"), F.col("v"), 2.0).alias("at_most"), vectors.gaussian_kernel(1.2, d).alias("kernel"))
    return rounded(out, "squared", "at_most", "kernel")


@query(f"SELECT a.vec_id AS id, round(avg(exp(-1.0 * {_PAIR})), 6) AS density FROM embeddings a, embeddings b GROUP BY a.vec_id")
def exact_kde(spark, sf_dir):
    x = datasets.embedding_points(spark, sf_dir)
    return rounded(kde.exact_kde(x, x, 1.0), "density")


_SIMILAR = f"SELECT a.vec_id AS i, b.vec_id AS j, round(exp(-{{a}} * {_PAIR}), 6) AS weight FROM embeddings a, embeddings b WHERE exp(-{{a}} * {_PAIR}) > 1e-10"


@query(_SIMILAR.format(a=8.0))
def similarity_graph(spark, sf_dir):
    """Of a narrow kernel."""
    return rounded_fast(kde.similarity_graph(datasets.embedding_points(spark, sf_dir), 8.0).edges, "weight")


@query(_SIMILAR.format(a=1.0))
def similarity_graph_embeddings(spark, sf_dir):
    """Of a wide kernel, so all points are neighbours."""
    return rounded_fast(kde.similarity_graph(datasets.embedding_points(spark, sf_dir), 1.0).edges, "weight")


@query(f"""WITH k AS (SELECT a.vec_id AS id, b.vec_id AS j, exp(-1.0 * {_PAIR}) AS k FROM embeddings a, embeddings b),
 r AS (SELECT id, j, sum(k) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING) AS upto, sum(k) OVER (PARTITION BY id) AS total FROM k),
 w AS (SELECT id, draw, ((id * 7919 + draw * 104729 + 11) % 10007) / 10007.0 AS u FROM (SELECT DISTINCT id FROM k), (VALUES (0), (1)) t(draw))
 SELECT w.id, w.draw::BIGINT AS draw, min(j) AS neighbour FROM w JOIN r ON r.id = w.id AND upto >= u * total GROUP BY w.id, w.draw""")
def kde_neighbour_samples(spark, sf_dir):
    x = datasets.embedding_points(spark, sf_dir)
    draws = x.select("id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("draw")).withColumn("u", F.expr("((id * 7919 + draw * 104729 + 11) % 10007) / 10007D"))
    return kde.sample_neighbours(x, x, 1.0, draws)


def uniform_sql(*terms: str) -> str:
    """text_uniform of terms, whose texts are the same in both engines."""
    return f"(('0x' || substr(md5(concat_ws(',', {', '.join(terms)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


# levels, units, each copy's points in them, the kernel sum of each copy, and the median of copies
@query(f"""WITH c AS (SELECT count(*) AS n, ceil(log2(count(*)))::BIGINT AS top, ceil(ln(count(*)))::BIGINT AS copies FROM embeddings),
 l AS (SELECT c.*, k, top - 2 * k AS t FROM c, (SELECT unnest(range(64)) AS k) WHERE k <= ceil(top / 2.0)),
 s AS (SELECT l.*, unnest(range(top - t + 1)) AS j FROM l),
 p AS (SELECT *, least(1.0, CASE WHEN j = 0 THEN 1.0 / n ELSE pow(2.0, -j - t) END)::DOUBLE AS p FROM s),
 u AS (SELECT *, CASE WHEN p <= 0.5 THEN 1 - 2 * p ELSE 0 END AS begin_, CASE WHEN j = 0 THEN top - t ELSE j - 1 END * ln(2) AS inner_, CASE WHEN j = 0 THEN 1e300 ELSE j * ln(2) END AS outer_ FROM p),
 o AS (SELECT vec_id AS id, copy, {uniform_sql('vec_id', 'copy', '42')} AS draw FROM embeddings, (SELECT unnest(range(copies)) AS copy FROM c)),
 h AS (SELECT u.k, u.p, inner_, outer_, copy, id FROM u JOIN o ON draw >= begin_ AND draw < begin_ + p),
 d AS (SELECT a.vec_id AS q, b.vec_id AS id, {_PAIR} AS d FROM embeddings a, embeddings b),
 f AS (SELECT q, k, copy, sum(exp(-d) / p) AS mu FROM h JOIN d USING (id) WHERE d > inner_ AND d <= outer_ GROUP BY ALL),
 g AS (SELECT e.vec_id AS q, l.k, l.t, copies, copy FROM embeddings e, l, unnest(range(copies)) AS x(copy)),
 m AS (SELECT q, k, t, list_sort(list(coalesce(mu, 0.0)))[any_value(copies) // 2 + 1] AS mu FROM g LEFT JOIN f USING (q, k, copy) GROUP BY q, k, t),
 r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN mu > 0 AND ln(greatest(mu, 1e-300)) >= 1.3 * t THEN k ELSE 1000 - k END) AS rank FROM m)
 SELECT q AS id, round(mu / (SELECT n FROM c), 6) AS density FROM r WHERE rank = 1""")
def ckns_kde(spark, sf_dir):
    x = datasets.embedding_points(spark, sf_dir)
    return rounded(kde.ckns_kde(x, x, 1.0), "density")


@query("""WITH n AS (SELECT count(*) AS n, ceil(log2(count(*)))::BIGINT AS top FROM embeddings),
 t AS (SELECT n, top, top - 2 * k AS log_nmu FROM n, (SELECT unnest(range(64)) AS k) WHERE k <= ceil(top / 2.0)),
 j AS (SELECT n, top, log_nmu, unnest(range(top - log_nmu + 1)) AS j FROM t)
 SELECT log_nmu::INTEGER AS log_nmu, j::INTEGER AS shell, least(1.0, CASE WHEN j = 0 THEN 1.0 / n ELSE pow(2.0, -j - log_nmu) END)::DOUBLE AS p, round(j * ln(2) / 1.5, 6) AS radius_squared FROM j""")
def ckns_parameters(spark, sf_dir):
    """Sampling rates and radii of all shells of all levels."""
    n = datasets.read(spark, sf_dir, "embeddings").count()
    rows = [(t, j, kde.sampling_probability(j, t, n, 0), round(kde.shell_radius_squared(j, 1.5), 6)) for t in kde.ckns_levels(n, 1 / n) for j in range(kde.shells(n, t) + 1)]
    return spark.createDataFrame(rows, "log_nmu int, shell int, p double, radius_squared double")


# an integral for the error function: Simpson's rule in 2000 steps
_ERF = "(2 / sqrt(pi()) * ({x}) / 6000 * (SELECT sum(CASE WHEN i % 2000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(({x}) * i / 2000, 2))) FROM (SELECT unnest(range(2001)) AS i)))"
_COLLIDE = f"CASE WHEN c < 1 THEN 1 - 0.2 * c ELSE {_ERF.format(x='2 * sqrt(2) / greatest(c, 0.5)')} - c / (2 * sqrt(2 * pi())) * (1 - exp(-8 / greatest(c * c, 0.25))) END"


@query(f"""WITH n AS (SELECT ceil(log2(count(*)))::BIGINT AS total FROM embeddings), j AS (SELECT total, unnest(range(1, total + 1)) AS j FROM n),
 c AS (SELECT j, ceil(j / total::DOUBLE * (total - j + 1)) AS phi, sqrt(j * ln(2) / 1.5) AS c FROM j), p AS (SELECT j, phi, {_COLLIDE} AS p FROM c)
 SELECT j::INTEGER AS shell, greatest(1, floor(-phi / log2(p)))::INTEGER AS functions, ceil(0.1 * pow(2, phi))::INTEGER AS tables FROM p""")
def ckns_hash_parameters(spark, sf_dir):
    """Functions and tables of the hash that would serve each shell of the lowest level."""
    n = datasets.read(spark, sf_dir, "embeddings").count()
    total = kde.shells(n, 0)
    return spark.createDataFrame([(j, *kde.lsh_parameters(total, j, 1.5, 0.1)) for j in range(1, total + 1)], "shell int, functions int, tables int")


# of tables of up to 5000 points, which are one leaf
@query(f"""WITH k AS (SELECT a.vec_id AS id, b.vec_id AS j, exp(-1.0 * {_PAIR}) AS k FROM embeddings a, embeddings b),
 r AS (SELECT id, j, sum(k) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING) AS upto, sum(k) OVER (PARTITION BY id) AS total FROM k),
 w AS (SELECT id, draw, {uniform_sql('id', 'draw', "'leaf'", '42')} AS u FROM (SELECT DISTINCT id FROM k), (VALUES (0), (1)) t(draw)),
 e AS (SELECT w.id AS i, draw, min(j) AS j, any_value(total) * (SELECT (count(*) - 1) / count(*) FROM embeddings) / 5 AS weight FROM w JOIN r ON r.id = w.id AND upto >= u * total GROUP BY w.id, draw)
 SELECT i, j, round(sum(weight), 6) AS weight FROM (SELECT i, j, weight FROM e UNION ALL SELECT j, i, weight FROM e) GROUP BY i, j""")
def approximate_similarity_graph(spark, sf_dir):
    return rounded(kde.approximate_similarity_graph(datasets.embedding_points(spark, sf_dir), 1.0).edges, "weight")


# hashing: projections of a fixed seed, as literals in both engines

_TABLES, _FUNCTIONS = 3, 2


def _hash_sql() -> str:
    tables = []
    for t in range(_TABLES):
        f = lsh.MultiLSHFunction(64, _FUNCTIONS, 42 * 1_000_003 + t)
        cells = [f"{int(f.factors[k])} * floor(list_sum(list_transform(list_zip(embedding, [{', '.join(repr(float(v)) for v in f.projections[k])}]), lambda z: z[1]::DOUBLE * z[2])) + {float(f.offsets[k])!r})::BIGINT" for k in range(_FUNCTIONS)]
        tables.append(f"SELECT {t}::BIGINT AS \"table\", ({' + '.join(cells)})::BIGINT AS bucket, vec_id AS id FROM embeddings")
    return " UNION ALL ".join(tables)


def _line_sql() -> str:
    f = lsh.LSHFunction(64, 42)
    return f"SELECT vec_id AS id, floor(list_sum(list_transform(list_zip(embedding, [{', '.join(repr(float(v)) for v in f.a)}]), lambda z: z[1]::DOUBLE * z[2])) + {f.b!r})::BIGINT AS cell FROM embeddings"


@query(_line_sql())
def lsh_hash(spark, sf_dir):
    return datasets.embedding_points(spark, sf_dir).select("id", lsh.LSHFunction(64, 42)(F.col("x")).alias("cell"))


@query(_hash_sql())
def lsh_buckets(spark, sf_dir):
    x = datasets.embedding_points(spark, sf_dir)
    return lsh.E2LSH(_FUNCTIONS, _TABLES, x, 64).buckets(x)


@query(f"WITH b AS ({_hash_sql()}) SELECT DISTINCT q.id AS query_id, b.id FROM b q JOIN b USING (\"table\", bucket) WHERE q.id % 100 = 0")
def lsh_near_neighbors(spark, sf_dir):
    """Bucket partners of every id divisible by 100 among all points."""
    x = datasets.embedding_points(spark, sf_dir)
    return lsh.E2LSH(_FUNCTIONS, _TABLES, x, 64).near_neighbours(x.filter("id % 100 = 0"))


@query(f"WITH b AS ({_hash_sql()}) SELECT DISTINCT q.id AS query_id, b.id FROM b q JOIN b USING (\"table\", bucket)")
def lsh_near_neighbors_embeddings(spark, sf_dir):
    """Bucket partners of all embeddings."""
    x = datasets.embedding_points(spark, sf_dir)
    return lsh.E2LSH(_FUNCTIONS, _TABLES, x, 64).near_neighbours(x)


@query(f"""WITH d AS (SELECT unnest([0.0, 0.05, 0.2, 0.99, 1.0, 1.5, 2.0, 5.6])::DOUBLE AS c), p AS (SELECT c, {_COLLIDE} AS p FROM d)
 SELECT c AS distance, round(p, 6) AS one, round(1 - pow(1 - pow(p, 5), 10), 6) AS tables FROM p""")
def e2lsh_collision_probability(spark, sf_dir):
    rows = [(c, vectors.line_collision_probability(c), vectors.table_collision_probability(5, 10, c)) for c in (0.0, 0.05, 0.2, 0.99, 1.0, 1.5, 2.0, 5.6)]
    return rounded(spark.createDataFrame(rows, "distance double, one double, tables double"), "one", "tables")


# random graphs: the coin of a pair is integer arithmetic in both engines

_U = "((((i * 7919 + j * 104729 + {s} * 1299709 + 1) % 2147483647) * 48271 + 11) % 2147483647 * 69621 + j * 31 + 7) % 2147483647 / 2147483647.0::DOUBLE"
_COINS = "WITH x AS (SELECT i, j FROM " + _ROWS + " WHERE i < j AND {u} < {p}) SELECT i, j, 1.0::DOUBLE AS weight FROM x UNION ALL SELECT j, i, 1.0 FROM x"


@query(_COINS.format(90, 90, u=_U.format(s=42), p="CASE WHEN i // 30 = j // 30 THEN 0.6 ELSE 0.05 END"))
def sbm(spark, sf_dir):
    return random_graphs.sbm(spark, 90, 3, 0.6, 0.05, exact=True).edges


@query(_COINS.format(80, 80, u=_U.format(s=42), p="0.2"))
def erdos_renyi(spark, sf_dir):
    return random_graphs.erdos_renyi(spark, 80, 0.2, exact=True).edges


@query("SELECT id, (id // 30)::BIGINT AS label FROM (SELECT unnest(range(90)) AS id)")
def sbm_labels(spark, sf_dir):
    return random_graphs.sbm_labels(spark, 92, 3)


@query("SELECT id, CASE WHEN id < 4 THEN 0 ELSE 1 END::BIGINT AS label FROM (SELECT unnest(range(6)) AS id)")
def general_sbm_labels(spark, sf_dir):
    return random_graphs.general_sbm_labels(spark, [4, 2])


def _sbm_sql(sizes: list[int], p: list[list[float]]) -> str:
    """The drawn edges, a row each: endpoints from drawn numbers, or a coin for each pair."""
    begins, parts = np.concatenate([[0], np.cumsum(sizes)]).tolist(), []
    for a, b, prob, number in random_graphs.block_pairs(sizes, p):
        place = lambda which, size, a=a, b=b: f"floor({uniform_sql('k', str(a), str(b), str(which), '42')} * {size})::BIGINT"
        if number is None:
            rows = _ROWS.format(f"{begins[a]}, {begins[a + 1]}", f"{begins[b]}, {begins[b + 1]}")
            parts.append(f"SELECT i, j FROM {rows} WHERE {'i < j AND ' if a == b else ''}{_U.format(s=42)} < {prob}")
        else:
            second = f"({place(0, sizes[a])} + 1 + {place(1, sizes[a] - 1)}) % {sizes[a]}" if a == b else place(1, sizes[b])
            parts.append(f"SELECT {begins[a]} + {place(0, sizes[a])} AS i, {begins[b]} + {second} AS j FROM (SELECT unnest(range({number})) AS k)")
    return " UNION ALL ".join(f"({x})" for x in parts)


_SAMPLED = ([1000, 100, 10], [[0.4, 0.1, 0.1], [0.1, 0.7, 0.0], [0.1, 0.0, 1.0]])
_WRITTEN = ([300, 300], [[0.2, 0.01], [0.01, 0.2]])


@query(f"WITH x AS ({_sbm_sql(*_SAMPLED)}) SELECT i, j, count(*)::DOUBLE AS weight FROM (SELECT i, j FROM x UNION ALL SELECT j, i FROM x) GROUP BY i, j")
def general_sbm_sampled(spark, sf_dir):
    return random_graphs.general_sbm(spark, *_SAMPLED).edges


@query(f"SELECT i AS u, j AS v, 1.0::DOUBLE AS weight FROM ({_sbm_sql(*_WRITTEN)})")
def sbm_edgelist(spark, sf_dir):
    path = shared_path(spark, "sbm")
    random_graphs.general_sbm_edgelist(spark, path, *_WRITTEN)
    return edgelist.read_edges(spark, path)


# spectra: closed forms where there are some

_KINDS = {"cycle": lambda s: cycle_graph(s, 20), "complete": lambda s: complete_graph(s, 10)}


@query("""WITH c AS (SELECT 'cycle' AS graph, 1 - cos(2 * pi() * k / 20) AS v FROM (SELECT unnest(range(20)) AS k) UNION ALL SELECT 'complete', CASE WHEN k = 0 THEN 0 ELSE 10 / 9.0 END FROM (SELECT unnest(range(10)) AS k)),
 r AS (SELECT graph, row_number() OVER (PARTITION BY graph ORDER BY v) - 1 AS rank, round(v, 6) + 0.0 AS value FROM c) SELECT graph, rank::INTEGER AS rank, value FROM r WHERE rank < 5""")
def eigenvalues(spark, sf_dir):
    rows = [(name, r, float(v)) for name, make in _KINDS.items() for r, v in enumerate(spectrum.compute_eigenvalues(make(spark), spectrum.GraphMatrix.NORMALISED_LAPLACIAN, 5, spectrum.Which.SMALLEST))]
    return rounded(spark.createDataFrame([(g, r, abs(v)) for g, r, v in rows], "graph string, rank int, value double"), "value")


@query(graph_sql(f"{_REACH} SELECT id, min(c) AS cluster FROM r GROUP BY id", _GEO, recursive=True))
def spectral_cluster(spark, sf_dir):
    """Five clusters of a graph of five components: a cluster is named by its smallest vertex."""
    label = cluster.spectral_cluster(geo(spark, sf_dir), 5)
    least = label.groupBy("label").agg(F.min("id").alias("cluster"))
    return label.join(least, "label").select("id", "cluster")


@query("SELECT 16::BIGINT AS n, 1::BIGINT AS parts_cut, 8::BIGINT AS smaller")
def cheeger_cut(spark, sf_dir):
    """The cut of a barbell is its bridge."""
    g = barbell_graph(spark, 8)
    label = cluster.cheeger_cut(g)
    crossing = g.edges.join(label.toDF("i", "a"), "i").join(label.toDF("j", "b"), "j").filter("i < j and a <> b").count()
    ones = label.filter("label = 1").count()
    return spark.createDataFrame([(g.n, crossing, min(ones, g.n - ones))], "n long, parts_cut long, smaller long")


@query("SELECT unnest(range(10))::BIGINT AS id")
def local_cluster_acl(spark, sf_dir):
    """One bell of a barbell, from a vertex of it."""
    return cluster.local_cluster_acl(barbell_graph(spark, 10), 0, 0.8, 0.0001)


@query("SELECT unnest(range(50))::BIGINT AS id")
def local_cluster(spark, sf_dir):
    """The block of a vertex, of four that are sparsely linked."""
    g = random_graphs.sbm(spark, 200, 4, 0.6, 0.005)
    return cluster.local_cluster(Graph(stage(g.edges, "sbm"), g.n), 10, 1500.0)


@query()
def approximate_pagerank(spark, sf_dir):
    p, r = cluster.approximate_pagerank(geo(spark, sf_dir), {0: 1.0}, 0.2, 0.001)
    return spark.createDataFrame([(v, p.get(v, 0.0), r.get(v, 0.0)) for v in sorted(r)], "id long, p double, r double")


@query(graph_sql("SELECT id, CASE WHEN id = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS seed, true AS below FROM d"))
def approximate_pagerank_balance(spark, sf_dir):
    """What a walk's seed must have been, from p and r of all vertices: r + (p - (1 - alpha) * walk(p)) / alpha. And whether r is below epsilon * degree."""
    g, alpha, epsilon = ps(spark, sf_dir), 0.2, 0.00001
    p, r = cluster.approximate_pagerank(g, {0: 1.0}, alpha, epsilon)
    state = spark.createDataFrame([(v, p.get(v, 0.0), x) for v, x in r.items()], "id long, p double, r double")
    walked = matrices.times_vector(matrices.lazy_random_walk_matrix(g), state.select("id", F.col("p").alias("value"))).withColumnRenamed("value", "walked")
    all_ = g.degrees.join(state, "id", "left").join(walked, "id", "left").na.fill(0.0)
    seed = F.col("r") + (F.col("p") - (1 - alpha) * F.col("walked")) / alpha
    return rounded(all_.select("id", seed.alias("seed"), (F.col("r") < epsilon * F.col("degree")).alias("below")), "seed")


_NATIONS = "SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey) AS cluster FROM customer"


def _named(label: DataFrame) -> DataFrame:
    """Clusters by their smallest vertex."""
    least = label.groupBy("label").agg(F.min("id").alias("cluster"))
    return label.join(least, "label").select("id", "cluster")


def _nations(spark, sf_dir) -> int:
    return datasets.read(spark, sf_dir, "customer").select("c_nationkey").distinct().count()


@query(_NATIONS)
def kmeans_customers(spark, sf_dir):
    """As many clusters as nations, which lie far apart."""
    return _named(cluster.kmeans(datasets.customer_points(spark, sf_dir), _nations(spark, sf_dir)))


@query(_NATIONS)
def spectral_cluster_customers(spark, sf_dir):
    """As many clusters as nations, each a component."""
    return _named(cluster.spectral_cluster(datasets.customer_rings(spark, sf_dir), _nations(spark, sf_dir)))


@query("""WITH d AS (SELECT ceil(log2(count(*)))::BIGINT AS d FROM supplier) SELECT rank::INTEGER AS rank, round(CASE WHEN rank = 0 THEN 0 ELSE 2.0 / d END, 6) + 0.0 AS value FROM d, unnest(range(4)) AS u(rank)""")
def eigenvalues_hypercube(spark, sf_dir):
    """The lowest values of a hypercube of at least as many vertices as suppliers, by the solver that keeps vectors in tables."""
    bits = int(np.ceil(np.log2(datasets.read(spark, sf_dir, "supplier").count())))
    n = 1 << bits
    edges = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(*(F.col("id").bitwiseXOR(1 << k) for k in range(bits)))).alias("j"))
    system = spectrum.compute_eigensystem(Graph(stage(edges.withColumn("weight", F.lit(1.0)), "hypercube"), n), spectrum.GraphMatrix.NORMALISED_LAPLACIAN, 4, spectrum.Which.SMALLEST, dense_vertices=0)
    return rounded(spark.createDataFrame([(r, abs(float(v))) for r, v in enumerate(system.values)], "rank int, value double"), "value")


@query()
def kmeans(spark, sf_dir):
    return cluster.kmeans(datasets.embedding_points(spark, sf_dir), 10)


@query("SELECT count(*) AS n, 10::BIGINT AS clusters, 0::BIGINT AS misplaced FROM embeddings")
def kmeans_fixed_point(spark, sf_dir):
    """Clusters of embeddings, and how many points lie nearer to the mean of another cluster than to that of their own."""
    points = datasets.embedding_points(spark, sf_dir)
    held = points.join(stage(cluster.kmeans(points, 10, rounds=1000), "kmeans-labels"), "id")
    sums = held.select("label", F.posexplode("x").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("v")).orderBy("label", "k").collect()  # a row for each number of ten means
    means: dict[int, list[float]] = {}
    for r in sums:
        means.setdefault(r.label, []).append(r.v)
    far = F.create_map(*(y for c, m in means.items() for y in (F.lit(c).cast("long"), vectors.squared_distance(F.col("x"), F.lit(m)))))
    far = held.select("label", far.alias("far"))
    misplaced = F.count_if(F.col("far")[F.col("label")] > F.array_min(F.map_values("far")) + 1e-9)
    return far.agg(F.count("*").alias("n"), F.lit(len(means)).cast("long").alias("clusters"), misplaced.alias("misplaced"))


@query()
def spectral_cluster_embeddings(spark, sf_dir):
    """The full similarity graph of all embeddings, in ten clusters."""
    return cluster.spectral_cluster(kde.similarity_graph(datasets.embedding_points(spark, sf_dir), 1.0), 10)


@query(f"""WITH v AS (SELECT id, sqrt(-2 * ln(1 - {uniform_sql('id', '1', '42')})) * cos(2 * pi() * (1 - {uniform_sql('id', '2', '42')})) AS x FROM (SELECT unnest(range(100)) AS id))
 SELECT id, round(x / sqrt((SELECT sum(x * x) FROM v)), 6) + 0.0 AS value FROM v""")
def random_unit_vector(spark, sf_dir):
    return rounded(spectrum.random_unit_vector(spark, 100), "value")


__all__ = ["QUERIES", "SQL", "np"]
