"""Spectral, Cheeger and local clustering."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..work import stage
from .kmeans import kmeans
from .local_graph import StoredGraph
from .running import running_sums
from .spectrum import DENSE_VERTICES, GraphMatrix, Which, compute_eigensystem

#: Runs of k-means over eigenvectors, of which the best counts: one alone may end in a poor optimum.
RUNS = 8


def spectral_cluster(g: Graph, k: int, seed: int = 42, dense_vertices: int = DENSE_VERTICES) -> DataFrame:
    """(id, label): k-means of the rows of the k lowest eigenvectors of the normalised Laplacian; k from 1 to n / 2."""
    if not 1 <= k <= g.n // 2:
        raise ValueError(f"k lies between 1 and {g.n // 2}")
    system = compute_eigensystem(g, GraphMatrix.NORMALISED_LAPLACIAN, k, Which.SMALLEST, dense_vertices)
    return kmeans(system.points(g.spark), k, 100 * k, seed, runs=RUNS)


def cheeger_cut(g: Graph, dense_vertices: int = DENSE_VERTICES) -> DataFrame:
    """(id, label): the sweep set of the second eigenvector over the roots of degrees is 1, all else 0."""
    system = compute_eigensystem(g, GraphMatrix.NORMALISED_LAPLACIAN, 2, Which.SMALLEST, dense_vertices)
    scores = system.points(g.spark).select("id", F.col("x")[1].alias("x"))
    # isolated vertices count as 0
    scores = scores.join(g.degrees, "id").select("id", F.when(F.col("degree") > 0, F.col("x") / F.sqrt("degree")).otherwise(0.0).alias("value"))
    chosen = sweep_set(g, scores, g.total_volume()).withColumn("label", F.lit(1).cast("long"))
    return g.vertices.join(chosen, "id", "left").select("id", F.coalesce("label", F.lit(0).cast("long")).alias("label"))


# sweeps


def sweep_profile(g, scores: DataFrame) -> DataFrame:
    """(rank, id, cut, volume) of each prefix of vertices (id, value) in descending order of value, ties to the smaller id.

    A vertex changes the cut by its degree less twice the weight to itself and vertices before it, so running sums give the cuts.
    """
    scores = stage(scores.select("id", "value"), "sweep-scores")
    near = g.edges if isinstance(g, Graph) else g.neighbors_of(scores)
    key = lambda c: scores.select(F.col("id").alias(c), F.col("value").alias(f"value_{c}"))
    pairs = near.join(key("i"), "i").join(key("j"), "j", "left")  # a neighbour may have no score
    earlier = (F.col("value_j") > F.col("value_i")) | ((F.col("value_j") == F.col("value_i")) & (F.col("j") <= F.col("i")))
    volume = F.sum(F.when(F.col("i") == F.col("j"), 2 * F.col("weight")).otherwise(F.col("weight")))
    sums = pairs.groupBy(F.col("i").alias("id")).agg(volume.alias("volume"), F.coalesce(F.sum(F.when(earlier, F.col("weight"))), F.lit(0.0)).alias("back"))
    rows = scores.join(sums, "id", "left").select("id", "value", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce(F.col("volume") - 2 * F.col("back"), F.lit(0.0)).alias("cut"))
    return running_sums(rows, [F.desc("value"), F.asc("id")], ["cut", "volume"]).select("rank", "id", "cut", "volume")


def sweep_set(g, scores: DataFrame, total_volume: float | None = None) -> DataFrame:
    """Vertices (id) of the prefix of least conductance: the cut over the volume, or over the lesser of it and the rest's
    where the total is known. Only prefixes with a volume and a conductance below 2 count; ties go to the shorter one."""
    profile = stage(sweep_profile(g, scores), "sweep-profile")
    below = F.col("volume") if total_volume is None else F.least(F.col("volume"), F.lit(float(total_volume)) - F.col("volume"))
    ratio = F.try_divide(F.col("cut"), below)
    best = profile.filter((below > 0) & (ratio < 2)).agg(F.min(F.struct(ratio.alias("phi"), "rank")).alias("b")).first().b
    return profile.filter(F.col("rank") <= (best["rank"] if best else 0)).select("id")


# local clustering


class _Lists:
    """Degrees and neighbour lists by vertex, fetched from a graph a frontier at a time.

    The degree of a vertex is a sum made where the graph lies; a list comes to the driver when its vertex is pushed, and the volume of
    all pushed vertices is bounded by 1 / (alpha * epsilon). With degrees that are missing, those of other vertices on the edge of what is known
    come along, and the short ones of their lists, so there are about as many fetches as steps from the seed, not as pushes.
    """

    MORE, SHORT = 5000, 50

    def __init__(self, g):
        self.g, self.held, self.degrees, self.near = g, {}, {}, set()

    def _entries(self, vertices) -> DataFrame:
        ids = sorted(vertices)
        if isinstance(self.g, StoredGraph):
            return self.g.entries_of(ids)
        return self.g.neighbors_of(self.g.spark.createDataFrame([(v,) for v in ids], "id long"))

    def look(self, vertices) -> None:
        missing = set(vertices) - self.degrees.keys()
        if not missing:
            return
        self.near -= self.degrees.keys()
        missing |= set(sorted(self.near - missing)[: self.MORE])
        self.degrees |= dict.fromkeys(missing, 0.0)
        entry = F.when(F.col("i") == F.col("j"), 2 * F.col("weight")).otherwise(F.col("weight"))
        rows = self._entries(missing).groupBy("i").agg(F.sum(entry).alias("degree"), F.count("*").alias("n")).collect()  # a row for each vertex of the frontier
        self.degrees |= {r.i: r.degree for r in rows}
        self._hold([r.i for r in rows if r.n <= self.SHORT])

    def _hold(self, vertices: list[int]) -> None:
        self.held |= {v: [] for v in vertices}
        if vertices:
            for r in self._entries(vertices).orderBy("i", "j").collect():  # short lists of a frontier, or that of a pushed vertex
                self.held[r.i].append((r.j, r.weight))
                self.near.add(r.j)

    def neighbours(self, v: int) -> list[tuple[int, float]]:
        if v not in self.held:
            self._hold([v])
        return self.held[v]


def approximate_pagerank(g, seed: dict[int, float], alpha: float, epsilon: float) -> tuple[dict[int, float], dict[int, float]]:
    """p and r with p + ppr(r) = ppr(seed) and r(u) < epsilon * degree(u): pushes one vertex at a time.

    A vertex that can be pushed again goes to the front of the queue, its neighbours to the back. Work depends on the
    result's size, not the graph's, so it runs on the driver over neighbour lists that come a frontier at a time.
    """
    _check_pagerank(g, seed, alpha, epsilon)
    lists, p, r = _Lists(g), {}, dict(seed)
    lists.look(r)
    queue = deque(u for u in sorted(r) if lists.degrees[u] != 0 and r[u] >= epsilon * lists.degrees[u])
    waiting = set(queue)
    while queue:
        u = queue.popleft()
        waiting.discard(u)
        near, degree = lists.neighbours(u), lists.degrees[u]
        mass = r[u]
        p[u] = p.get(u, 0.0) + alpha * mass
        r[u] = (1 - alpha) * mass / 2
        for v, w in near:  # a loop's share, counted twice, comes back
            r[v] = r.get(v, 0.0) + (1 - alpha) * mass * (2 * w if v == u else w) / (2 * degree)
        if r[u] >= epsilon * degree:
            queue.appendleft(u)
            waiting.add(u)
        lists.look(v for v, _ in near)
        for v, _ in near:
            if v not in waiting and r[v] >= epsilon * lists.degrees[v]:
                queue.append(v)
                waiting.add(v)
    return p, r


def _check_pagerank(g, seed, alpha: float, epsilon: float) -> None:
    if any(not g.vertex_exists(v) for v in seed):
        raise ValueError("a seed vertex isn't in the graph")
    if not 0 < alpha <= 1:
        raise ValueError("alpha lies between 0 (not itself) and 1")
    if epsilon <= 0:
        raise ValueError("epsilon is positive")


def pagerank_round(g: Graph, state: DataFrame, alpha: float, epsilon: float) -> DataFrame:
    """state (id, p, r) after all vertices with r >= epsilon * degree are pushed at once."""
    state = state.join(g.degrees.select("id", "degree"), "id").withColumn("push", F.when((F.col("degree") > 0) & (F.col("r") >= epsilon * F.col("degree")), F.col("r")).otherwise(0.0))
    sent = state.filter("push > 0").select(F.col("id").alias("i"), "push", "degree").join(g.edges, "i")
    share = (1 - alpha) * F.col("push") * F.when(F.col("i") == F.col("j"), 2 * F.col("weight")).otherwise(F.col("weight")) / (2 * F.col("degree"))
    got = sent.groupBy(F.col("j").alias("id")).agg(F.sum(share).alias("got"))
    out = state.select("id", "p", "r", "push").join(got, "id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("id", (zero("p") + alpha * zero("push")).alias("p"), (zero("r") - zero("push") + (1 - alpha) / 2 * zero("push") + zero("got")).alias("r"))


def bulk_pagerank(g: Graph, seed: DataFrame, alpha: float, epsilon: float, rounds: int = 1000) -> DataFrame:
    """(id, p, r) by rounds that push every vertex that may be pushed: another valid answer than one push at a time gives."""
    if not 0 < alpha <= 1 or epsilon <= 0:
        raise ValueError("alpha lies between 0 (not itself) and 1, and epsilon is positive")
    state = stage(seed.select("id", F.lit(0.0).alias("p"), F.col("value").alias("r")), "pagerank")
    for _ in range(rounds):
        can = state.join(g.degrees, "id").filter((F.col("degree") > 0) & (F.col("r") >= epsilon * F.col("degree")))
        if can.isEmpty():
            break
        state = stage(pagerank_round(g, state, alpha, epsilon), "pagerank")
    return state


def local_cluster_acl(g, seed: int, locality: float, error: float = 0.001) -> DataFrame:
    """Vertices (id) of the sweep set of the seed's approximate PageRank over degrees; denominators are volumes of the set."""
    if not g.vertex_exists(seed):
        raise ValueError(f"{seed} is no vertex")
    if not 0 <= locality <= 1 or error <= 0:
        raise ValueError("locality lies between 0 and 1, and the error is positive")
    p, _ = approximate_pagerank(g, {seed: 1.0}, locality, error)
    lists = _Lists(g)
    lists.look(p)
    scores = [(v, x / lists.degrees[v]) for v, x in p.items() if lists.degrees[v] > 0]
    return sweep_set(g, g.spark.createDataFrame(scores, "id long, value double"))


def local_cluster(g, seed: int, target_volume: float) -> DataFrame:
    if target_volume <= 0:
        raise ValueError("the target volume is positive")
    return local_cluster_acl(g, seed, 0.01, 1 / target_volume)


__all__ = ["approximate_pagerank", "bulk_pagerank", "cheeger_cut", "kmeans", "local_cluster", "local_cluster_acl", "pagerank_round", "running_sums", "spectral_cluster", "sweep_profile", "sweep_set"]
