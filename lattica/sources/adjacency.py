"""Adjacency lists: a line `id: neighbour[:weight] ...` for each vertex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, summed
from .edgelist import _checked, edge_line, number_text, read_edges
from .text import content_lines, is_content, write_lines

LIST = "array<struct<v:long,weight:double>>"


def parse_list(line: Column) -> Column:
    """Struct of id and neighbours (v, weight), in order of v; a line without a colon raises, a comment is null."""
    vertex = F.trim(F.substring_index(line, ":", 1)).try_cast("long")
    rest = F.when(line.contains(":"), F.regexp_replace(line, r"^[^:]*:", "")).otherwise(F.lit(""))
    parts = F.filter(F.split(F.trim(rest), r"[ \t,]+"), lambda t: t != "")
    pair = lambda t: F.struct(F.substring_index(t, ":", 1).try_cast("long").alias("v"), F.coalesce(F.when(t.contains(":"), F.substring_index(t, ":", -1).try_cast("double")), F.lit(1.0)).alias("weight"))
    found = F.array_sort(F.transform(parts, pair))
    good = line.contains(":") & vertex.isNotNull() & F.forall(found, lambda p: p["v"].isNotNull())
    row = F.struct(vertex.alias("id"), found.alias("neighbours"))
    return F.when(F.coalesce(good, F.lit(False)), row).when(is_content(line), F.raise_error(F.concat(F.lit("no list: "), line)).cast(f"struct<id:long,neighbours:{LIST}>"))


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """(id, neighbours) of every content line."""
    return content_lines(spark, path).select(parse_list(F.col("value")).alias("r")).select("r.*")


def list_entries(lists: DataFrame) -> DataFrame:
    """(u, v, weight) of every neighbour."""
    return lists.select(F.col("id").alias("u"), F.explode("neighbours").alias("p")).select("u", "p.v", "p.weight")


def load_adjacencylist(spark: SparkSession, path: str) -> Graph:
    """Entries as they are stated: an asymmetric list gives a GraphFormatError. n is the largest id in an edge + 1."""
    entries = _checked(list_entries(read_lists(spark, path)))
    return Graph.from_matrix(summed(entries.toDF("i", "j", "weight")))


def _lines(rows: DataFrame) -> DataFrame:
    """(k, value) for rows (id, v, weight), where v is null for a vertex without neighbours."""
    pair = F.when(F.col("v").isNotNull(), F.struct("v", F.concat(F.col("v").cast("string"), F.lit(":"), number_text(F.col("weight"))).alias("t")))
    grouped = rows.groupBy("id").agg(F.array_sort(F.collect_list(pair)).alias("p"))
    return grouped.select(F.col("id").alias("k"), F.concat_ws(" ", F.concat(F.col("id").cast("string"), F.lit(":")), F.array_join(F.transform("p", lambda x: x["t"]), " ")).alias("value"))


def save_adjacencylist(g: Graph, path: str) -> None:
    """A line for every vertex, isolated ones included."""
    rows = g.vertices.join(g.edges.toDF("id", "v", "weight"), "id", "left")
    header = ["# Adjacency list: a line `id: neighbour:weight ...` for each vertex", "# Vertices are in order, so one is found by binary search.", f"# Number of vertices: {g.n}", f"# Number of edges: {g.number_of_edges()}"]
    write_lines(_lines(rows), path, header)


def adjacencylist_to_edgelist(spark: SparkSession, source: str, target: str) -> None:
    """Edges u <= v, loops included."""
    edges = list_entries(read_lists(spark, source)).filter("u <= v")
    edges.repartitionByRange("u").sortWithinPartitions("u", "v").select(edge_line(F.col("u"), F.col("v"), F.col("weight")).alias("value")).write.mode("overwrite").text(target)


def edgelist_to_adjacencylist(spark: SparkSession, source: str, target: str) -> None:
    """Every edge in both directions; repeated edges and loops are written each time."""
    e = read_edges(spark, source)
    both = e.unionAll(e.select("v", "u", "weight")).toDF("id", "v", "weight")
    write_lines(_lines(both), target, ["# Adjacency list: a line `id: neighbour:weight ...` for each vertex"])
