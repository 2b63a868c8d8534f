"""Dense matrices as text, and points as rows (id, x array<double>)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .edgelist import number_text
from .text import content_lines, is_content, tokens, write_lines


def parse_numbers(line: Column) -> Column:
    """The numbers of a content line; anything else raises, a comment is null."""
    found = F.transform(tokens(line), lambda t: t.try_cast("double"))
    good = F.forall(found, lambda x: x.isNotNull())
    return F.when(good, found).when(is_content(line), F.raise_error(F.concat(F.lit("no numbers: "), line)).cast("array<double>"))


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(id, x) of the content lines, numbered from 0 in the file's order, or that of a folder's files by name; rows of unlike size give a RuntimeError."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = content_lines(spark, path).select(*place, F.monotonically_increasing_id().alias("k"), parse_numbers(F.col("value")).alias("x"))
    sizes = lines.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if sizes.least != sizes.most:
        raise RuntimeError("the matrix has rows of unlike size")
    return numbered(lines)


def numbered(rows: DataFrame) -> DataFrame:
    """(id, x) for rows (file, block, k, x): ids from 0 without gaps, by file, block and k.

    Blocks are read whole and in order, but Spark deals them to its partitions by size, so these say nothing of the order.
    """
    by_name = lambda r: ([int(t) if t.isdecimal() else t for t in re.split(r"(\d+)", r.file)], r.block)
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("k").alias("first")).collect()  # a row for each block
    begins, at = [], 0
    for r in sorted(blocks, key=by_name):
        begins.append((r.file, r.block, at - r.first))
        at += r.n
    starts = rows.sparkSession.createDataFrame(begins, "file string, block long, shift long")
    return rows.join(F.broadcast(starts), ["file", "block"]).select((F.col("k") + F.col("shift")).alias("id"), "x")


def row_text(x: Column) -> Column:
    """Numbers with a blank behind each."""
    return F.concat(F.array_join(F.transform(x, number_text), " "), F.lit(" "))


def save_matrix(points: DataFrame, path: str) -> None:
    write_lines(points.select(F.col("id").alias("k"), row_text(F.col("x")).alias("value")), path, [])


def point(points: DataFrame, k: int) -> list[float]:
    """The k-th row."""
    row = points.filter(F.col("id") == k).first()
    if row is None:
        raise ValueError(f"there is no row {k}")
    return list(row.x)
