"""Graphs on disk, of which local algorithms read only what they need."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adjacency import read_lists


#: Vertices of a list that goes to the scan.
FILTERED = 5000


class LocalGraph(Protocol):
    """What local algorithms need of a graph: a session, which vertices there are, and the entries (i, j, weight) of a frontier (id)."""

    spark: SparkSession

    def vertex_exists(self, v: int) -> bool: ...

    def neighbors_of(self, frontier: DataFrame) -> DataFrame: ...


class StoredGraph:
    """Entries (i, j, weight) that lie sorted by i in Parquet, whose statistics let a frontier skip most of them, or an adjacency list.

    Vertices are those with a line or row; ids needn't start at 0. Unlike in memory, a loop counts once in the unweighted degree.
    """

    def __init__(self, spark: SparkSession, entries: DataFrame, vertices: DataFrame | None = None):
        self.spark, self.entries = spark, entries
        self.vertices = vertices if vertices is not None else entries.select(F.col("i").alias("id")).distinct()

    @classmethod
    def open_parquet(cls, spark: SparkSession, path: str) -> StoredGraph:
        return cls(spark, spark.read.parquet(f"{path}/edges"))

    @classmethod
    def open_adjacencylist(cls, spark: SparkSession, path: str) -> StoredGraph:
        """A missing file raises an OSError; lines without a colon are passed over."""
        from ..sources.adjacency import parse_list
        from ..sources.text import content_lines

        rows = content_lines(spark, path).filter(F.col("value").contains(":")).select(parse_list(F.col("value")).alias("r")).select("r.*")
        entries = rows.select(F.col("id").alias("i"), F.explode("neighbours").alias("p")).select("i", F.col("p.v").alias("j"), F.col("p.weight"))
        return cls(spark, entries, rows.select("id"))

    def vertex_exists(self, v: int) -> bool:
        return not self.vertices.filter(F.col("id") == v).isEmpty()

    def _known(self, v: int) -> None:
        if not self.vertex_exists(v):
            raise RuntimeError(f"vertex {v} isn't in the file")

    def entries_of(self, ids: list[int]) -> DataFrame:
        """(i, j, weight) of vertices that the driver names; a short list reaches the scan as a filter, which skips row groups by their statistics."""
        if len(ids) > FILTERED:
            return self.neighbors_of(self.spark.createDataFrame([(v,) for v in ids], "id long"))
        return self.entries.filter(F.col("i").isin(ids) & F.col("i").between(min(ids, default=0), max(ids, default=-1)))

    def neighbors_of(self, frontier: DataFrame) -> DataFrame:
        ids = frontier.select(F.col("id").alias("i")).distinct()
        return self.entries.join(ids, "i", "left_semi")

    def neighbors(self, v: int) -> DataFrame:
        self._known(v)
        return self.entries.filter(F.col("i") == v).toDF("v1", "v2", "weight")

    def neighbors_unweighted(self, v: int) -> DataFrame:
        return self.neighbors(v).select("v2")

    def degrees_of(self, ids: DataFrame) -> DataFrame:
        """(pos, id, degree, degree_unweighted) for rows (pos, id)."""
        loop = F.col("i") == F.col("j")
        own = self.neighbors_of(ids).groupBy(F.col("i").alias("id")).agg(F.sum(F.when(loop, 2 * F.col("weight")).otherwise(F.col("weight"))).alias("degree"), F.count("*").alias("degree_unweighted"))
        return ids.join(own, "id", "left").select("pos", "id", F.coalesce("degree", F.lit(0.0)).alias("degree"), F.coalesce("degree_unweighted", F.lit(0)).alias("degree_unweighted"))

    def degree(self, v: int) -> float:
        self._known(v)
        return self.degrees_of(self.spark.createDataFrame([(0, v)], "pos long, id long")).first().degree

    def degree_unweighted(self, v: int) -> int:
        self._known(v)
        return self.degrees_of(self.spark.createDataFrame([(0, v)], "pos long, id long")).first().degree_unweighted


__all__ = ["LocalGraph", "StoredGraph", "read_lists"]
