"""Edge lists: a line `u v [weight]` for each edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..work import stage
from .text import content_lines, is_comment, is_content, tokens, write_lines

EDGE = "struct<u:long,v:long,weight:double>"


def parse_edge(line: Column) -> Column:
    """u, v and weight (1 where it is missing) of a content line; anything else raises, a comment is null."""
    t = tokens(line)
    u, v, w = (F.try_element_at(t, F.lit(k)) for k in (1, 2, 3))
    u, v, number = u.try_cast("long"), v.try_cast("long"), w.try_cast("double")
    good = F.size(t).isin(2, 3) & u.isNotNull() & v.isNotNull() & (u >= 0) & (v >= 0) & (w.isNull() | number.isNotNull())
    edge = F.struct(u.alias("u"), v.alias("v"), F.coalesce(number, F.lit(1.0)).alias("weight"))
    return F.when(F.coalesce(good, F.lit(False)), edge).when(is_content(line), F.raise_error(F.concat(F.lit("no edge: "), line)).cast(EDGE))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(u, v, weight) of every content line."""
    return content_lines(spark, path).select(parse_edge(F.col("value")).alias("e")).select("e.*")


def load_edgelist(spark: SparkSession, path: str) -> Graph:
    """Both directions of every edge, repeated ones added up (a loop counts twice); n is the largest id + 1."""
    return Graph.from_edges(_checked(read_edges(spark, path)).toDF("i", "j", "weight"))


def _checked(parsed: DataFrame) -> DataFrame:
    """The parsed lines, staged: the parser runs once, and a bad line gives its error here."""
    try:
        return stage(parsed, "parsed-lines")
    except Exception as e:  # Spark's error class for raise_error differs by mode
        if "no edge" in str(e) or "no list" in str(e):
            raise RuntimeError(f"a line can't be read: {str(e).splitlines()[0]}") from e
        raise


def edge_line(u: Column, v: Column, weight: Column) -> Column:
    return F.concat_ws(" ", u.cast("string"), v.cast("string"), number_text(weight))


def number_text(x: Column) -> Column:
    """A double in full precision, whole numbers without a point."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def save_edgelist(g: Graph, path: str) -> None:
    """Edges u < v below a header. Loops and isolated vertices are lost, as the format has no place for them; Parquet keeps both."""
    rows = g.edges.filter("i < j").select("i", "j", edge_line(F.col("i"), F.col("j"), F.col("weight")).alias("value"))
    write_lines(rows, path, ["# Edge list: a line `u v weight` for each edge", f"# Number of vertices: {g.n}", f"# Number of edges: {g.number_of_edges()}"], ("i", "j"))


def duplicate_edges(spark: SparkSession, source: str, target: str) -> None:
    """Copies an edge list with every edge in both directions; comments stay."""
    lines = spark.read.text(source).filter("trim(value) <> ''")
    e = parse_edge(F.col("value"))
    both = F.array(F.col("value"), edge_line(e["v"], e["u"], e["weight"]))
    lines.select(F.explode(F.when(is_comment(F.col("value")), F.array("value")).otherwise(both)).alias("value")).write.mode("overwrite").text(target)


def edgelist_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: n_lines (of edges) and n_vertices (largest id + 1)."""
    return read_edges(spark, path).agg(F.count("*").alias("n_lines"), (F.coalesce(F.max(F.greatest("u", "v")), F.lit(-1)) + 1).alias("n_vertices"))


def sort_edgelist(spark: SparkSession, source: str, target: str) -> None:
    """Content lines in order of their first vertex, which Spark's sort spills as it must; leading comments are dropped."""
    lines = content_lines(spark, source)
    keyed = lines.select(parse_edge(F.col("value"))["u"].alias("u"), F.monotonically_increasing_id().alias("k"), "value")
    keyed.repartitionByRange("u").sortWithinPartitions("u", "k").select("value").write.mode("overwrite").text(target)


def save_parquet(g: Graph, path: str) -> None:
    """Lossless: edges sorted by vertex, so a reader skips row groups, and the number of vertices beside them."""
    g.edges.repartitionByRange("i").sortWithinPartitions("i", "j").write.mode("overwrite").parquet(f"{path}/edges")
    g.spark.createDataFrame([(g.n,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/vertices")


def load_parquet(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/vertices").first().n)


__all__ = ["duplicate_edges", "edgelist_stats", "is_content", "load_edgelist", "load_parquet", "parse_edge", "read_edges", "save_edgelist", "save_parquet", "sort_edgelist"]
