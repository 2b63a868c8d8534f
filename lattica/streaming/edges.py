"""Structured Streaming over folders of edge lists: the parser of the batch source, and degrees that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.edgelist import parse_edge
from ..sources.text import is_content


def stream_edges(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(u, v, weight) of every content line of files as they appear in the folder; a bad line fails the query."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.filter(is_content(F.col("value"))).select(parse_edge(F.col("value")).alias("e")).select("e.*")


def running_degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, degree_unweighted) over all edges so far; state is a row for each vertex, and partial sums are made before the shuffle.

    Repeated edges count each time, and a loop twice, as they do on loading.
    """
    ends = edges.select(F.explode(F.array("u", "v")).alias("id"), "weight")
    return ends.groupBy("id").agg(F.sum("weight").alias("degree"), F.count("*").alias("degree_unweighted"))
