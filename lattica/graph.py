"""Undirected weighted graphs as symmetric edge tables.

`edges` has a row (i, j, weight) for each stored entry of the adjacency matrix: both directions of an edge, a loop
once. `n` is the number of vertices, whose ids are 0 to n - 1; isolated ones have no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import GraphFormatError

EDGE_SCHEMA = "i long, j long, weight double"
#: Entries of at most this size are dropped on construction.
EPSILON = 1e-10


class Edge(NamedTuple):
    v1: int
    v2: int
    weight: float = 1.0


def summed(entries: DataFrame) -> DataFrame:
    """Entries (i, j, weight) with equal places added up."""
    return entries.groupBy("i", "j").agg(F.sum("weight").alias("weight"))


def symmetrised(entries: DataFrame) -> DataFrame:
    """Every entry in both directions, added up; a loop thus counts twice, as it does on insertion."""
    return summed(entries.select("i", "j", "weight").unionAll(entries.select("j", "i", "weight")))


def asymmetric_entries(entries: DataFrame) -> DataFrame:
    """Entries whose mirror image is missing or differs."""
    mirror = entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight")
    return entries.join(mirror, ["i", "j", "weight"], "left_anti")


def is_symmetric(entries: DataFrame) -> bool:
    return asymmetric_entries(entries).isEmpty()


def adjacency_from(entries: DataFrame) -> DataFrame:
    """The adjacency entries behind an adjacency or Laplacian matrix; any negative entry means a Laplacian.

    A Laplacian must have no non-negative entry off the diagonal and no negative column sum; what a column sums to is
    its vertex's loop. One aggregate decides, and tiny entries are dropped.
    """
    off = F.col("i") != F.col("j")
    seen = entries.agg(F.max(F.col("weight") < 0).alias("negative"), F.max(off & (F.col("weight") >= 0)).alias("positive_off")).first()
    if not seen.negative:
        return entries.filter(F.col("weight") > EPSILON)
    if seen.positive_off:
        raise GraphFormatError("a Laplacian has no non-negative entry off its diagonal")
    columns = entries.groupBy("j").agg(F.sum("weight").alias("weight"))
    if not columns.filter(F.col("weight") < -EPSILON).isEmpty():
        raise GraphFormatError("a Laplacian's columns sum to nothing negative")
    flipped = entries.filter(off).withColumn("weight", -F.col("weight"))
    loops = columns.select(F.col("j").alias("i"), "j", "weight")
    return flipped.unionByName(loops).filter(F.col("weight") > EPSILON)


class Graph:
    """An immutable graph; every operation returns a new one."""

    def __init__(self, edges: DataFrame, n: int, validate: bool = False):
        self.edges = edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("weight").cast("double").alias("weight"))
        self.n = int(n)
        if validate and not is_symmetric(self.edges):
            raise GraphFormatError("the adjacency matrix isn't symmetric")

    # construction

    @classmethod
    def from_matrix(cls, entries: DataFrame, n: int | None = None) -> Graph:
        """From entries (i, j, weight) of an adjacency or Laplacian matrix."""
        entries = entries.select("i", "j", "weight")
        if n is None:
            largest = entries.agg(F.max(F.greatest("i", "j"))).first()[0]
            n = 0 if largest is None else largest + 1
        return cls(adjacency_from(entries), n, validate=True)

    @classmethod
    def from_csc(cls, spark: SparkSession, starts: Sequence[int], rows: Sequence[int], values: Sequence[float]) -> Graph:
        """From compressed columns: where each column starts, row indices and values."""
        if len(rows) != len(values) or not starts or starts[-1] != len(values):
            raise ValueError("the compressed columns don't fit together")
        entries = [(int(rows[k]), j, float(values[k])) for j in range(len(starts) - 1) for k in range(starts[j], starts[j + 1])]
        return cls.from_matrix(spark.createDataFrame(entries, EDGE_SCHEMA), len(starts) - 1)

    @classmethod
    def from_edges(cls, edges: DataFrame, n: int | None = None) -> Graph:
        """From one row (i, j, weight) per undirected edge; repeated edges add up and a loop adds twice its weight."""
        entries = symmetrised(edges)
        if n is None:
            largest = edges.agg(F.max(F.greatest("i", "j"))).first()[0]
            n = 0 if largest is None else largest + 1
        return cls(entries.filter(F.abs("weight") > EPSILON), n)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @cached_property
    def vertices(self) -> DataFrame:
        return self.spark.range(self.n)

    # mutation and algebra

    def add_edge(self, i: int, j: int, weight: float) -> Graph:
        """Adds to what is there; n grows to hold both ends."""
        if i < 0 or j < 0:
            raise ValueError("vertices aren't negative")
        if weight < 0:
            raise ValueError("weights aren't negative")
        new = self.spark.createDataFrame([(i, j, float(weight)), (j, i, float(weight))], EDGE_SCHEMA)
        return Graph(summed(self.edges.unionByName(new)).filter(F.col("weight") > EPSILON), max(self.n, i + 1, j + 1))

    def remove_edge(self, i: int, j: int) -> Graph:
        gone = ((F.col("i") == i) & (F.col("j") == j)) | ((F.col("i") == j) & (F.col("j") == i))
        return Graph(self.edges.filter(~gone), self.n)

    def subgraph(self, vertices: Sequence[int]) -> Graph:
        """Induced by the vertices, numbered by their first occurrence."""
        order = list(dict.fromkeys(int(v) for v in vertices))
        if any(v < 0 or v >= self.n for v in order):
            raise ValueError("a vertex isn't in the graph")
        ids = self.spark.createDataFrame(list(zip(order, range(len(order)), strict=True)), "v long, k long")
        return self.relabelled(ids, len(order))

    def relabelled(self, ids: DataFrame, n: int) -> Graph:
        """Induced by the vertices of ids (v, k), under their new numbers k."""
        a, b = ids.toDF("i", "new_i"), ids.toDF("j", "new_j")
        return Graph(self.edges.join(a, "i").join(b, "j").select(F.col("new_i").alias("i"), F.col("new_j").alias("j"), "weight"), n)

    def disjoint_union(self, other: Graph) -> Graph:
        moved = other.edges.select((F.col("i") + self.n).alias("i"), (F.col("j") + self.n).alias("j"), "weight")
        return Graph(self.edges.unionByName(moved), self.n + other.n)

    def __add__(self, other: Graph) -> Graph:
        if self.n != other.n:
            raise ValueError("only graphs of equally many vertices add up")
        return Graph(summed(self.edges.unionByName(other.edges)).filter(F.col("weight") > EPSILON), self.n)

    def __mul__(self, factor: float) -> Graph:
        if factor < 0:
            raise GraphFormatError("a graph times a negative number is none")
        return Graph(self.edges.withColumn("weight", F.col("weight") * float(factor)).filter(F.col("weight") > EPSILON), self.n)

    __rmul__ = __mul__

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, Graph):
            return NotImplemented
        return self.n == other.n and self.edges.exceptAll(other.edges).isEmpty() and other.edges.exceptAll(self.edges).isEmpty()

    __hash__ = None

    # aggregates

    @cached_property
    def degrees(self) -> DataFrame:
        """(id, degree, degree_unweighted) of every vertex; a loop counts twice in both."""
        loop = F.col("i") == F.col("j")
        own = self.edges.groupBy("i").agg(F.sum(F.when(loop, 2 * F.col("weight")).otherwise(F.col("weight"))).alias("d"), (F.count("*") + F.count_if(loop)).alias("u"))
        joined = self.vertices.join(own, self.vertices.id == own.i, "left")
        return joined.select("id", F.coalesce("d", F.lit(0.0)).alias("degree"), F.coalesce("u", F.lit(0)).alias("degree_unweighted"))

    def totals(self) -> DataFrame:
        """One row: total_volume, average_degree, n_vertices, n_edges, has_self_loops."""
        loop = F.col("i") == F.col("j")
        volume = F.coalesce(F.sum(F.when(loop, 2 * F.col("weight")).otherwise(F.col("weight"))), F.lit(0.0))
        average = F.try_divide(volume, F.lit(float(self.n)))
        return self.edges.agg(
            volume.alias("total_volume"), average.alias("average_degree"), F.lit(self.n).cast("long").alias("n_vertices"),
            F.count_if(F.col("i") <= F.col("j")).alias("n_edges"), (F.count_if(loop) > 0).alias("has_self_loops"),
        )

    def total_volume(self) -> float:
        return self.totals().first().total_volume

    def average_degree(self) -> float:
        return self.totals().first().average_degree

    def number_of_vertices(self) -> int:
        return self.n

    def number_of_edges(self) -> int:
        return self.totals().first().n_edges

    def has_self_loops(self) -> bool:
        return not self.edges.filter("i = j").isEmpty()

    # lookups

    def check_vertex(self, v: int) -> None:
        if not 0 <= v < self.n:
            raise ValueError(f"{v} is no vertex: there are {self.n}")

    def vertex_exists(self, v: int) -> bool:
        return 0 <= v < self.n

    def degree(self, v: int) -> float:
        self.check_vertex(v)
        return self.degrees.filter(F.col("id") == v).first().degree

    def degree_unweighted(self, v: int) -> int:
        self.check_vertex(v)
        return self.degrees.filter(F.col("id") == v).first().degree_unweighted

    def neighbors(self, v: int) -> DataFrame:
        """(v1, v2, weight) of the vertex; a loop once."""
        self.check_vertex(v)
        return self.edges.filter(F.col("i") == v).toDF("v1", "v2", "weight")

    def neighbors_unweighted(self, v: int) -> DataFrame:
        return self.neighbors(v).select("v2")

    def degrees_of(self, ids: DataFrame) -> DataFrame:
        """(pos, id, degree, degree_unweighted) for rows (pos, id), whose repetitions stay."""
        return ids.join(self.degrees, "id").select("pos", "id", "degree", "degree_unweighted")

    # the access that local algorithms need, a frontier at a time

    def neighbors_of(self, frontier: DataFrame) -> DataFrame:
        """(i, j, weight) of all vertices of frontier (id)."""
        return self.edges.join(frontier.select(F.col("id").alias("i")).distinct(), "i", "left_semi")


#: Numbers that one row makes at once.
STRETCH = 1 << 14


def ranges(rows: DataFrame, begin: Column, end: Column, name: str, spread: bool = False) -> DataFrame:
    """rows with `name`: each row once for every number from begin to end - 1, in stretches, so that no row holds a long array.

    Where few rows make very many, `spread` deals the stretches out to all tasks.
    """
    whole = rows.withColumns({"range_begin": begin, "range_end": end}).filter("range_begin < range_end")
    whole = whole.withColumn("range_at", F.explode(F.sequence(F.col("range_begin"), F.col("range_end") - 1, F.lit(STRETCH).cast("long"))))
    if spread:
        whole = whole.repartition(*whole.columns)
    last = F.least(F.col("range_at") + STRETCH, F.col("range_end")) - 1
    return whole.withColumn(name, F.explode(F.sequence(F.col("range_at"), last))).drop("range_begin", "range_end", "range_at")


def _named(spark: SparkSession, n: int, least: int = 2) -> DataFrame:
    if n < least:
        raise ValueError(f"this graph has at least {least} vertices")
    return spark.range(n)


def cycle_graph(spark: SparkSession, n: int) -> Graph:
    ids = _named(spark, n)
    return Graph(symmetrised(ids.select(F.col("id").alias("i"), F.pmod(F.col("id") + 1, F.lit(n)).alias("j"), F.lit(1.0).alias("weight"))), n)


def complete_graph(spark: SparkSession, n: int) -> Graph:
    """All n * (n - 1) entries, made from n rows by generating each vertex's others, a bounded stretch of them at a time."""
    edges = ranges(_named(spark, n).select(F.col("id").alias("i")), F.lit(0).cast("long"), F.lit(n).cast("long"), "j").filter("i <> j")
    return Graph(edges.withColumn("weight", F.lit(1.0)), n)


def barbell_graph(spark: SparkSession, n: int) -> Graph:
    """Two complete graphs of n vertices, joined by an edge."""
    both = complete_graph(spark, n).disjoint_union(complete_graph(spark, n))
    bridge = spark.createDataFrame([(n - 1, n, 1.0), (n, n - 1, 1.0)], EDGE_SCHEMA)
    return Graph(both.edges.unionByName(bridge), 2 * n)


def star_graph(spark: SparkSession, n: int) -> Graph:
    """Vertex 0 in the center."""
    _named(spark, n)
    return Graph(symmetrised(spark.range(1, n).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("weight"))), n)


def identity_graph(spark: SparkSession, n: int) -> Graph:
    """A loop of weight 1 on every vertex."""
    ids = _named(spark, n, 1)
    return Graph(ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("weight")), n)
