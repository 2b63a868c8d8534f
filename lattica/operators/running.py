"""Running sums in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..work import stage


def running_sums(rows: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """rows with `rank` (from 1) and the running sums of columns in a total order, without gathering all rows in one task.

    Rows are dealt by ranges of the order; each range sums on its own, and starts from the totals of the ranges before it.
    """
    n = F.monotonically_increasing_id()  # the range in its high bits
    placed = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", n), "sweep-order").withColumn("part", F.shiftright("n", 33))
    totals = placed.groupBy("part").agg(F.count("*").alias("size"), *(F.sum(c).alias(c) for c in columns)).orderBy("part").collect()  # a row for each range
    before, at = [], [0] + [0.0] * len(columns)
    for r in totals:
        before.append((r.part, *at))
        at = [at[0] + r["size"], *(x + (r[c] or 0.0) for x, c in zip(at[1:], columns, strict=True))]
    names = [f"before_{c}" for c in columns]
    begins = rows.sparkSession.createDataFrame(before, ", ".join(["part long", "before_rank long", *(f"{c} double" for c in names)]))
    within = Window.partitionBy("part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("n")).cast("long"))
    out = out.withColumns({c: F.sum(c).over(within) for c in columns}).join(F.broadcast(begins), "part")
    return out.withColumns({c: F.col(c) + F.col(b) for c, b in zip(columns, names, strict=True)}).withColumn("rank", F.col("rank") + F.col("before_rank")).drop("part", "n", "before_rank", *names)
