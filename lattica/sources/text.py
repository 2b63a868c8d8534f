"""Lines of the text formats.

Lines that are blank or begin with # or / are comments. A content line is split at commas if that gives a token, else at
blanks, else at tabs; empty tokens don't count.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the content lines. A path that can't be read gives an OSError."""
    return spark.read.text(_existing(spark, path)).filter(is_content(F.col("value")))


def _existing(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(2, os.strerror(2), path)
    return path


def is_content(line: Column) -> Column:
    bare = F.trim(line)
    return (bare != "") & ~line.startswith("#") & ~line.startswith("/")


def is_comment(line: Column) -> Column:
    return line.startswith("#") | line.startswith("/")


def tokens(line: Column) -> Column:
    """The tokens of a line, by the first delimiter of comma, blank and tab that occurs in it."""
    parts = lambda by: F.filter(F.transform(F.split(line, by), lambda t: F.trim(F.regexp_replace(t, r"[\t\r]", " "))), lambda t: t != "")
    plain = F.trim(line)
    return F.when(plain.contains(","), parts(",")).when(plain.contains(" "), parts(" ")).otherwise(parts("\t"))


def write_lines(lines: DataFrame, path: str, header: list[str], order: tuple[str, ...] = ("k",)) -> None:
    """The column `value` of rows in the order of some columns (of numbers from 0 on), below the header lines, as a folder of text files."""
    top = lines.sparkSession.createDataFrame([(-len(header) + i, h) for i, h in enumerate(header)], f"{order[0]} long, value string")
    rows = top.select(*(F.col(order[0]) if c == order[0] else F.lit(0).cast("long").alias(c) for c in order), "value")
    rows = rows.unionByName(lines.select(*(F.col(c).cast("long").alias(c) for c in order), "value"))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)
