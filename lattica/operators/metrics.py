"""Cluster quality: label tables are (id, label), with labels from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..work import stage


def _nan() -> Column:
    return F.lit(float("nan"))


def n_choose_2(n: int) -> int:
    if n < 0:
        raise ValueError("n isn't negative")
    return n * (n - 1) // 2


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def check_labels(truth: DataFrame, labels: DataFrame) -> None:
    """Both name the same vertices with labels of 0 or more; one job."""
    _checked_cells(truth, labels)


def _checked_cells(truth: DataFrame, labels: DataFrame) -> DataFrame:
    """The contingency table, staged. Vertices that one side lacks make cells of their own, so the same pass tells whether the labels are sound."""
    cells = truth.toDF("id", "truth").join(labels.toDF("id", "label"), "id", "full").groupBy("truth", "label").agg(F.count("*").alias("n"))
    cells = stage(cells, "contingency")
    if not cells.filter("truth is null or label is null or truth < 0 or label < 0").isEmpty():
        raise ValueError("the labellings differ in size or hold a negative label")
    return cells


def contingency_table(truth: DataFrame, labels: DataFrame) -> DataFrame:
    """(truth, label, n) of the pairs that occur. Labellings of unlike vertices and negative labels raise."""
    return _checked_cells(truth, labels)


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """(label, n)."""
    return labels.toDF("id", "label").groupBy("label").agg(F.count("*").alias("n"))


def _grouped(truth: DataFrame, labels: DataFrame) -> DataFrame:
    """(kind, a, b, n): the table's cells, its two margins and its total, in one pass over the cells."""
    cells = contingency_table(truth, labels)
    return cells.groupingSets([["truth", "label"], ["truth"], ["label"], []], "truth", "label").agg(F.sum("n").alias("n"), F.grouping_id().alias("kind"))


def adjusted_rand_index(truth: DataFrame, labels: DataFrame) -> DataFrame:
    """One row `ari`; NaN where chance agreement leaves nothing to tell."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, _pairs(F.col("n"))).otherwise(0.0))
    sums = _grouped(truth, labels).agg(of(0).alias("cells"), of(1).alias("a"), of(2).alias("b"), of(3).alias("all"))
    expected = F.try_divide(F.col("a") * F.col("b"), F.col("all"))
    below = (F.col("a") + F.col("b")) / 2 - expected
    return sums.select(F.when(F.coalesce(below, F.lit(0.0)) == 0, _nan()).otherwise(F.try_divide(F.col("cells") - expected, below)).alias("ari"))


def entropy(labels: DataFrame) -> DataFrame:
    """One row `entropy`, in bits: log N - sum(n log n) / N."""
    sums = cluster_sizes(labels).agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    return sums.select((F.log2("N") - F.col("nlogn") / F.col("N")).alias("entropy"))


def _information(truth: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mi and both entropies, from the grouping sets."""
    groups = _grouped(truth, labels)
    total = F.sum(F.when(F.col("kind") == 3, F.col("n")))
    plogp = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n") * F.log2("n")))
    # H = log N - sum(n log n) / N, and MI = H(a) + H(b) - H(a, b)
    sums = groups.agg(total.alias("N"), plogp(0).alias("ab"), plogp(1).alias("a"), plogp(2).alias("b"))
    h = lambda c: F.log2("N") - F.col(c) / F.col("N")
    return sums.select((h("a") + h("b") - h("ab")).alias("mi"), h("a").alias("h_truth"), h("b").alias("h_labels"))


def mutual_information(truth: DataFrame, labels: DataFrame) -> DataFrame:
    """One row `mutual_information`, in bits."""
    return _information(truth, labels).select(F.col("mi").alias("mutual_information"))


def normalised_mutual_information(truth: DataFrame, labels: DataFrame) -> DataFrame:
    """One row `nmi`: over the mean of both entropies; NaN where both are 0."""
    mean = (F.col("h_truth") + F.col("h_labels")) / 2
    return _information(truth, labels).select(F.when(mean <= 1e-12, _nan()).otherwise(F.try_divide(F.col("mi"), mean)).alias("nmi"))


def conductance(g: Graph, cluster: DataFrame) -> DataFrame:
    """One row `conductance` of the vertices (id): weight that leaves over all weight, loops once; 0 where there is none.

    A vertex that is listed several times counts as often.
    """
    inside = cluster.select(F.col("id").alias("j")).distinct().withColumn("inside", F.lit(True))
    rows = g.edges.join(cluster.select(F.col("id").alias("i")), "i").join(inside, "j", "left")
    out = F.coalesce(F.sum(F.when(F.col("inside").isNull(), F.col("weight"))), F.lit(0.0))
    return rows.agg(F.coalesce(F.try_divide(out, F.sum("weight")), F.lit(0.0)).alias("conductance"))


def symmetric_difference(s: DataFrame, t: DataFrame) -> DataFrame:
    """Ids in one of the sets only, without repetitions, in order."""
    marked = s.select("id", F.lit(1).alias("side")).unionAll(t.select("id", F.lit(2).alias("side")))
    return marked.groupBy("id").agg(F.min("side").alias("a"), F.max("side").alias("b")).filter("a = b").select("id").orderBy("id")
