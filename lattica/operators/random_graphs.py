"""Stochastic block models, by coins or by sampled endpoints; all draws are hashes, so they don't depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import text_uniform
from ..graph import Graph, ranges, symmetrised
from ..sources.edgelist import edge_line

#: Pairs of a block pair from which on endpoints are sampled, where the probability is below one half.
SAMPLED_PAIRS = 10_000

# Fixed values of the arithmetic hash of a pair, which SQL can express: two odd factors and a prime.
HASH_A, HASH_B, HASH_C, HASH_P = 7919, 104729, 1299709, 2147483647


def pair_uniform(i: Column, j: Column, seed: int) -> Column:
    """A number in [0, 1) of a pair, in integer arithmetic modulo a prime."""
    x = (i * HASH_A + j * HASH_B + seed * HASH_C + 1) % HASH_P
    x = (x * 48271 + 11) % HASH_P
    x = (x * 69621 + j * 31 + 7) % HASH_P
    return x / float(HASH_P)


def _check(sizes: Sequence[int], p: Sequence[Sequence[float]]) -> None:
    if any(s < 1 for s in sizes):
        raise ValueError("blocks have at least one vertex")
    if len(p) != len(sizes) or any(len(row) != len(sizes) for row in p):
        raise ValueError("the probabilities are a row and a column for each block")
    if any(not 0 <= x <= 1 for row in p for x in row):
        raise ValueError("probabilities lie between 0 and 1")


def block_pairs(sizes: Sequence[int], p: Sequence[Sequence[float]], exact: bool = False, seed: int = 42) -> list[tuple[int, int, float, int | None]]:
    """(block, block, probability, edges to draw) of all block pairs with edges; None edges where every pair of vertices tosses a coin."""
    _check(sizes, p)
    rng, out = np.random.default_rng(seed), []
    for a in range(len(sizes)):
        for b in range(a, len(sizes)):
            prob, pairs = float(p[a][b]), sizes[a] * sizes[b]
            if prob == 0:
                continue
            if pairs < SAMPLED_PAIRS or prob >= 0.5 or exact:
                out.append((a, b, prob, None))
                continue
            most = pairs // 2 if a == b else pairs
            if prob * most >= 1:
                out.append((a, b, prob, int(min(most, max(0, np.floor(rng.normal(prob * most, np.sqrt((1 - prob) * prob * most))))))))
    return out


def sbm_edges(spark: SparkSession, sizes: Sequence[int], p: Sequence[Sequence[float]], exact: bool = False, seed: int = 42) -> DataFrame:
    """(i, j, weight): a row per drawn edge, i < j inside a block. Of p the upper triangle counts.

    Block pairs of many vertices and a low probability draw a Gaussian number of edges with uniform endpoints, so
    an edge may be drawn several times; all others toss a coin for every pair. Block pairs are rows of one table, which makes
    rows for vertices, pairs and draws where they are needed; nothing is joined, and the plan is the same for any number of blocks.
    """
    begins = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    rows = [(a, b, prob, number, begins[a], sizes[a], begins[b], sizes[b]) for a, b, prob, number in block_pairs(sizes, p, exact, seed)]
    pairs = spark.createDataFrame(rows, "a long, b long, prob double, number long, begin_a long, size_a long, begin_b long, size_b long")
    same = F.col("a") == F.col("b")
    tossed = ranges(pairs.filter("number is null"), F.col("begin_a"), F.col("begin_a") + F.col("size_a"), "i", spread=True)
    tossed = ranges(tossed, F.when(same, F.col("i") + 1).otherwise(F.col("begin_b")), F.col("begin_b") + F.col("size_b"), "j")
    tossed = tossed.filter(pair_uniform(F.col("i"), F.col("j"), seed) < F.col("prob"))
    drawn = ranges(pairs.filter("number is not null"), F.lit(0).cast("long"), F.col("number"), "k", spread=True)
    place = lambda which, size: F.floor(text_uniform(F.col("k"), F.col("a"), F.col("b"), F.lit(which), F.lit(seed)) * size).cast("long")
    # inside a block the second end is a drawn step away from the first, so no vertex meets itself
    step = F.pmod(place(0, F.col("size_a")) + 1 + place(1, F.col("size_a") - 1), F.col("size_a"))
    drawn = drawn.filter(~same | (F.col("size_a") > 1)).select((F.col("begin_a") + place(0, F.col("size_a"))).alias("i"), (F.col("begin_b") + F.when(same, step).otherwise(place(1, F.col("size_b")))).alias("j"))
    return tossed.select("i", "j").unionAll(drawn).withColumn("weight", F.lit(1.0))


def general_sbm(spark: SparkSession, sizes: Sequence[int], p: Sequence[Sequence[float]], exact: bool = False, seed: int = 42) -> Graph:
    return Graph(symmetrised(sbm_edges(spark, sizes, p, exact, seed)), sum(sizes))


def expected_neighbours(spark: SparkSession, sizes: Sequence[int], p: Sequence[Sequence[float]]) -> DataFrame:
    """(id, expected): how many neighbours a vertex of each drawn block has on average."""
    _check(sizes, p)
    rows = [(b, float(sum(s * q for s, q in zip(sizes, p[b], strict=True)))) for b in range(len(sizes))]
    return general_sbm_labels(spark, sizes).join(F.broadcast(spark.createDataFrame(rows, "label long, expected double")), "label").select("id", "expected")


def _blocks(n: int, k: int, p: float, q: float) -> tuple[list[int], list[list[float]]]:
    if n < 1:
        raise ValueError("there is at least one vertex")
    if not 1 <= k <= max(1, n // 2):
        raise ValueError("there are between 1 and n / 2 clusters")
    return [n // k] * k, [[p if a == b else q for b in range(k)] for a in range(k)]


def sbm(spark: SparkSession, n: int, k: int, p: float, q: float, exact: bool = False, seed: int = 42) -> Graph:
    """k clusters of n // k vertices each; what n has beyond them is left out."""
    return general_sbm(spark, *_blocks(n, k, p, q), exact, seed)


def erdos_renyi(spark: SparkSession, n: int, p: float, exact: bool = False, seed: int = 42) -> Graph:
    return sbm(spark, n, 1, p, 0.0, exact, seed)


def general_sbm_edgelist(spark: SparkSession, path: str, sizes: Sequence[int], p: Sequence[Sequence[float]], exact: bool = False, seed: int = 42) -> None:
    """Drawn edges straight to text files below a header; nothing is gathered."""
    edges = sbm_edges(spark, sizes, p, exact, seed)
    shown = [f"# Probabilities: {[list(r) for r in p]}"] if len(sizes) <= 20 else []
    header = spark.createDataFrame([(h,) for h in ["# Stochastic block model", f"# Block sizes: {list(sizes)[:20]}", *shown]], "value string").coalesce(1)
    header.unionByName(edges.select(edge_line(F.col("i"), F.col("j"), F.col("weight")).alias("value"))).write.mode("overwrite").text(path)


def general_sbm_labels(spark: SparkSession, sizes: Sequence[int]) -> DataFrame:
    """(id, label) of the drawn blocks."""
    if any(s < 1 for s in sizes):
        raise ValueError("blocks have at least one vertex")
    begins = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    blocks = spark.createDataFrame([(b, begins[b], int(s)) for b, s in enumerate(sizes)], "label long, begin long, size long")
    return ranges(blocks, F.col("begin"), F.col("begin") + F.col("size"), "id", spread=True).select("id", "label")


def sbm_labels(spark: SparkSession, n: int, k: int) -> DataFrame:
    return general_sbm_labels(spark, _blocks(n, k, 1.0, 1.0)[0])
