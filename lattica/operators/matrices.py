"""Matrices of a graph as entry tables (i, j, value), and products with them."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..work import stage
from .running import running_sums


def adjacency(g: Graph) -> DataFrame:
    return g.edges.withColumnRenamed("weight", "value")


def _diagonal(g: Graph, value: Column) -> DataFrame:
    return g.degrees.select(F.col("id").alias("i"), F.col("id").alias("j"), value.alias("value"))


def degree_matrix(g: Graph) -> DataFrame:
    """A diagonal entry for every vertex, 0 for isolated ones."""
    return _diagonal(g, F.col("degree"))


def inverse_degree_matrix(g: Graph) -> DataFrame:
    """1 / degree, 0 for isolated vertices."""
    return _diagonal(g, F.when(F.col("degree") == 0, 0.0).otherwise(F.try_divide(F.lit(1.0), F.col("degree"))))


def _added(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("i", "j").agg(F.sum("value").alias("value"))


def _scaled(g: Graph, sign: float) -> DataFrame:
    """sign * D^-1/2 A D^-1/2; degrees meet the entries by two joins on a key each."""
    d = g.degrees.select("id", F.sqrt("degree").alias("root"))
    joined = g.edges.join(d.toDF("i", "root_i"), "i").join(d.toDF("j", "root_j"), "j")
    return joined.select("i", "j", (sign * F.col("weight") / (F.col("root_i") * F.col("root_j"))).alias("value"))


def laplacian(g: Graph) -> DataFrame:
    return _added(degree_matrix(g), g.edges.select("i", "j", (-F.col("weight")).alias("value")))


def signless_laplacian(g: Graph) -> DataFrame:
    return _added(degree_matrix(g), adjacency(g))


def normalised_laplacian(g: Graph) -> DataFrame:
    return _added(_diagonal(g, F.lit(1.0)), _scaled(g, -1.0))


def normalised_signless_laplacian(g: Graph) -> DataFrame:
    return _added(_diagonal(g, F.lit(1.0)), _scaled(g, 1.0))


def lazy_random_walk_matrix(g: Graph) -> DataFrame:
    """1/2 I + 1/2 A D^-1: columns sum to 1."""
    d = g.degrees.select(F.col("id").alias("j"), "degree")
    walk = g.edges.join(d, "j").select("i", "j", (F.col("weight") / (2 * F.col("degree"))).alias("value"))
    return _added(_diagonal(g, F.lit(0.5)), walk)


def times_vector(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(id, value) of matrix (i, j, value) times a sparse vector (id, value)."""
    v = vector.select(F.col("id").alias("j"), F.col("value").alias("x"))
    return matrix.join(v, "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def compressed_column_tables(matrix: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Columns' starts (j, start) for j from 0 to n, and entries (place, i, value) in order of column and row; for matrices of any size."""
    placed = running_sums(matrix.select("j", "i", "value"), [F.asc("j"), F.asc("i")], [])
    entries = stage(placed.select((F.col("rank") - 1).alias("place"), "i", "j", "value"), "compressed-columns")
    sizes = matrix.sparkSession.range(n).withColumnRenamed("id", "j").join(entries.groupBy("j").agg(F.count("*").cast("double").alias("size")), "j", "left")
    ends = running_sums(sizes.select("j", F.coalesce("size", F.lit(0.0)).alias("size")), [F.asc("j")], ["size"])
    ends = ends.select((F.col("j") + 1).alias("j"), F.col("size").cast("long").alias("start"))
    first = matrix.sparkSession.createDataFrame([(0, 0)], "j long, start long")
    return first.unionByName(ends), entries.select("place", "i", "value")


def compressed_columns(matrix: DataFrame, n: int) -> tuple[list[int], list[int], list[float]]:
    """Column starts, row indices and values. For matrices that fit the driver."""
    rows = matrix.orderBy("j", "i").collect()
    starts, at = [0] * (n + 1), 0
    for j in range(n):
        while at < len(rows) and rows[at].j <= j:
            at += 1
        starts[j + 1] = at
    return starts, [r.i for r in rows], [r.value for r in rows]


def print_vector(vector: DataFrame, file: TextIO | None = None) -> None:
    """Writes the values of (id, value) in order of id, a line each, to a stream (standard error unless told). For vectors that one reads."""
    for r in vector.orderBy("id").toLocalIterator():
        print(r.value, file=file or sys.stderr)


def dense_vector(vector: DataFrame, n: int) -> DataFrame:
    """(id, value) for ids 0 to n - 1, with 0 where the sparse vector has none."""
    if n < 1:
        raise ValueError("a dense vector has at least one component")
    return vector.sparkSession.range(n).join(vector, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


def add_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of vectors (id, value), of which the shorter ends in zeros."""
    other = b.withColumnRenamed("value", "other")
    return a.join(other, "id", "full").select("id", (F.coalesce("value", F.lit(0.0)) + F.coalesce("other", F.lit(0.0))).alias("value"))
