"""Connected components over edge tables of any orderable key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..work import shuffled
from ..work import stage as staged


def component_labels(edges: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(v, label) for every vertex of edges (a, b); equal labels mean one component, and a label is a vertex of it.

    Every round each vertex takes the neighbour (or itself) of least hash, edges are redrawn between the vertices taken, and
    the rest goes on with those: hash order makes a round shrink any graph by a constant share on average, so rounds
    grow with the logarithm of its size, whatever its diameter. Minima combine before the shuffle, so a vertex
    of many edges is no hot spot there; the joins are on one row per vertex, so Spark may split a hot vertex. `stage`
    writes a round's tables and reads them back.
    """
    rounds: list[DataFrame] = []
    edges = edges.toDF("a", "b").filter("a <> b").distinct()
    while True:
        edges = stage(edges, "contracted-edges")
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
        taken = both.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("v"), F.least(rank("a"), F.col("near"))["x"].alias("label"))
        taken = stage(taken, "contraction")
        rounds.append(taken)
        edges = (
            edges.join(shuffled(taken.toDF("a", "to_a")), "a").join(shuffled(taken.toDF("b", "to_b")), "b")
            .filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        )
    if not rounds:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
    labels = rounds[-1]
    for taken in reversed(rounds[:-1]):
        later = labels.toDF("label", "final")
        labels = taken.join(shuffled(later), "label", "left").select("v", F.coalesce("final", "label").alias("label"))
    return stage(labels, "labels") if len(rounds) > 1 else labels


def connected_components(g: Graph) -> DataFrame:
    """(id, component) of every vertex; component is the smallest vertex of it."""
    labels = component_labels(g.edges.select("i", "j"), staged).toDF("id", "label")
    own = g.vertices.join(shuffled(labels), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    least = own.groupBy("label").agg(F.min("id").alias("component"))
    return own.join(shuffled(least), "label").select("id", "component")


def component_lists(g: Graph) -> DataFrame:
    """(component, members): a row for each component, with its vertices in order. For components that fit a row."""
    return connected_components(g).groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members")).orderBy("component")


def connected_component(g, v: int) -> DataFrame:
    """Vertices (id) that v reaches.

    Of a graph of edges all components are found, in rounds that grow with the logarithm of its size, whatever the depth. Whatever else has
    neighbors_of(frontier), as a stored graph, is searched by rounds of a frontier, whose neighbours that weren't
    reached before are the next one: work grows with the component, rounds with its depth.
    """
    if not g.vertex_exists(v):
        raise ValueError(f"{v} is no vertex")
    if isinstance(g, Graph):
        labels = component_labels(g.edges.select("i", "j"), staged)
        own = labels.filter(F.col("v") == v).select("label")
        alone = g.spark.createDataFrame([(v,)], "id long")
        return labels.join(own, "label", "left_semi").select(F.col("v").alias("id")).union(alone).distinct()
    spark = g.spark
    reached = spark.createDataFrame([(v,)], "id long")
    frontier = reached
    while True:
        near = g.neighbors_of(frontier).select(F.col("j").alias("id")).distinct()
        frontier = staged(near.join(reached, "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            return reached
        reached = staged(reached.unionByName(frontier), "reached")


def is_connected(g: Graph) -> bool:
    """Whether all vertices are one component; a graph without vertices isn't connected."""
    if g.n <= 1:
        return g.n == 1
    labels = component_labels(g.edges.select("i", "j"), staged)
    seen = labels.agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).first()
    return seen.n == g.n and seen.least == seen.most
