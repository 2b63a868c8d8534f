"""Exact top-k inner products over norm-sorted vectors.

Components become integers. An eigenbasis of the summed outer products (the right singular vectors of all
vectors) rotates them, so most of a product lies in the first rotated components. Candidates are cut into blocks by
descending length, queries into blocks of their own; a block is one packed row. Candidate blocks are met in rounds, those of the
longest vectors first and GROWTH times as many with every round. Each query keeps its k best so far, the least of which is its
floor: a block whose longest vector times the query's length can't reach any floor of a query block is not sent to it, and the
search ends where no block can. Within a pair of blocks, partial sums over the first components, plus the product of what is
left of both lengths (Cauchy-Schwarz), prune candidates; the most promising raise the floor, and what still
reaches it is scored exactly in integers. Bounds have room for rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

#: Rows of a block; a pair of blocks is a unit of work.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 2048
#: How many times as many candidate blocks are known after a round as before it.
GROWTH = 8
#: Squared lengths beyond this count for the rotation as this one: any basis is right, and sums stay finite.
LONG = 1e200


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, length2): components as doubles; vectors that are null, empty or hold null or non-finite components are left out."""
    whole = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.coalesce(whole, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.withColumn("length2", F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x))


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Columns: eigenvectors of the summed outer products, largest eigenvalue first."""

    def gram(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            with np.errstate(over="ignore"):
                length2 = (x * x).sum(1)
            x = np.where((length2 > LONG)[:, None], 0.0, x)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.reshape(-1))], ["cell", "value"])

    cells = rows.select("x").mapInArrow(gram, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # width * width rows
    total = np.zeros(width * width)
    for r in cells:
        total[r.cell] = r.value
    values, basis = np.linalg.eigh(total.reshape(width, width))
    return np.ascontiguousarray(basis[:, ::-1])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        few = np.flatnonzero(scores >= least)
        return few[np.lexsort((ids[few], -scores[few]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in integers of any size."""
    flat = [int(np.floor(c * scale)) if abs(c) * scale < float("inf") else int(c) * scale for c in x.reshape(-1).tolist()]
    return np.array(flat, object).reshape(x.shape)


class _Side:
    """A block's vectors as doubles (rounded down), in the rotated basis, and what their lengths leave beyond the head."""

    def __init__(self, x: np.ndarray, scale: int, basis: np.ndarray, head: int):
        self.raw = x
        with np.errstate(over="ignore", invalid="ignore"):
            self.floored = np.floor(x * scale)
            rotated = self.floored @ basis
            self.head, self.left, self.length = rotated[:, :head], np.linalg.norm(rotated[:, head:], axis=1), np.linalg.norm(rotated, axis=1)
            self.most = float(np.abs(self.floored).max(initial=0))


def search(x: _Side, ids: np.ndarray, q: _Side, own: np.ndarray, floors: np.ndarray, k: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score): the best k of a block for each query, but only such as reach the query's floor."""
    highest = x.most * q.most * x.raw.shape[1]
    if highest < 2.0**52:
        score = lambda keep, j: np.rint(x.floored[keep] @ q.floored[j]).astype(np.int64)
    elif highest < 2.0**62:
        xi, qi = x.floored.astype(np.int64), q.floored.astype(np.int64)
        score = lambda keep, j: xi[keep] @ qi[j]
    else:  # a score among the best that is no 64-bit integer raises, at the end
        xo, qo = _integers(x.raw, scale), _integers(q.raw, scale)
        score = lambda keep, j: xo[keep] @ qo[j]
    longest, out = x.length.max(initial=0), []
    for begin in range(0, len(own), 128):
        part = slice(begin, begin + 128)
        with np.errstate(over="ignore", invalid="ignore"):
            room = 1e-6 * (1 + longest * q.length[part])
            bounds = q.head[part] @ x.head.T + q.left[part, None] * x.left + room[:, None]
        bounds[np.isnan(bounds)] = np.inf
        for i, bound in enumerate(bounds):
            j = begin + i
            keep = np.flatnonzero((ids != own[j]) & (bound >= floors[j]))
            if len(keep) > 8 * k:  # those of the highest bounds come first, and raise the floor for all others
                order = np.argpartition(-bound[keep], 4 * k)
                first, rest = keep[order[: 4 * k]], keep[order[4 * k :]]
                scores = score(first, j)
                floor = max(float(np.partition(scores, len(scores) - k)[len(scores) - k]), floors[j])
                rest = rest[bound[rest] >= floor * (1 - 1e-9 if floor > 0 else 1 + 1e-9)]
                keep, scores = np.concatenate([first, rest]), np.concatenate([scores, score(rest, j)])
            elif len(keep):
                scores = score(keep, j)
            else:
                continue
            best = _best(scores, ids[keep], k)
            out.append((np.full(len(best), j), ids[keep][best], scores[best].astype(np.int64)))
    return tuple(np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [[]] * 3))


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with rows of another id, ties to the smaller id; all of them if fewer.

    vectors and queries have id_col and vector_col; a component x counts as floor(scale * x), however large it is, and a score
    among the best beyond 64 bits raises. Vectors that are null, empty or hold null or non-finite components take no part, nor do those of another
    width than the commonest, which have no inner product with the others. Rows that repeat an id each count as candidates; queries
    that repeat an id and vector are one. Empty tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors, id_col, vector_col), "vectors")
    asked = usable(queries, id_col, vector_col).dropDuplicates(["id", "x"])
    widths = rows.groupBy(F.size("x").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = widths[0].w
    rows, asked = rows.filter(F.size("x") == width), asked.filter(F.size("x") == width)
    basis = rotation(rows, width)
    head = max(1, width // 4)

    def pack(block: pa.Table) -> pa.Table:
        x = _matrix(block.column("x").combine_chunks(), width)
        floors = np.full(len(x), -np.inf)
        return pa.table(
            {
                "block": block.column("block")[:1], "ids": [block.column("id").to_numpy().astype("<i8").tobytes()], "x": [x.astype("<f8").tobytes()],
                "longest": pa.array([float(_Side(x, scale, basis, head).length.max())]), "best": [np.zeros(len(x) * (2 * k + 1), np.int64).tobytes()], "floors": [floors.tobytes()],
            }
        )

    packed = "block long, ids binary, x binary, longest double, best binary, floors binary"
    # numbered by descending length: a block is a stretch of that order
    candidates = stage(_numbered(rows, CANDIDATE_BLOCK).groupBy("block").applyInArrow(pack, packed).drop("best", "floors"), "candidate-blocks")
    state = stage(_numbered(asked, QUERY_BLOCK).groupBy("block").applyInArrow(pack, packed).drop("longest"), "query-blocks")
    lengths = candidates.select(F.col("block").alias("candidate_block"), "longest")
    n_blocks = candidates.count()

    def reaches(batches):
        """The least floor over length of a block's queries: what a candidate's length must reach."""
        for batch in batches:
            least = []
            for x, floors in zip(batch.column("x").to_pylist(), batch.column("floors").to_pylist(), strict=True):
                length, floor = _Side(np.frombuffer(x, "<f8").reshape(-1, width), scale, basis, head).length, np.frombuffer(floors, "<f8")
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(length > 0, floor / length, np.where(floor > 0, np.inf, -np.inf))
                least.append(float(np.nan_to_num(need, nan=-np.inf, posinf=np.inf, neginf=-np.inf).min()))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(least, pa.float64())], ["query_block", "reach"])

    def meet(batches):
        for batch in batches:
            for r in batch.to_pylist():
                sides = [_Side(np.frombuffer(r[c], "<f8").reshape(-1, width), scale, basis, head) for c in ("x", "query_x")]
                found = search(sides[0], np.frombuffer(r["ids"], "<i8"), sides[1], np.frombuffer(r["query_ids"], "<i8"), np.frombuffer(r["floors"], "<f8"), k, scale)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), r["query_block"])), *(pa.array(c, pa.int64()) for c in found)], ["query_block", "place", "vec_id", "score"])

    def tighten(held: pa.Table, found: pa.Table) -> pa.Table:
        """A query block's k best so far with what a round has found."""
        if not held.num_rows:
            return held
        n = len(held.column("ids")[0].as_py()) // 8
        scores, names, has = _unpacked(held.column("best")[0].as_py(), n, k)
        old = np.arange(k) < has[:, None]
        score, name, place = (np.concatenate([x, found.column(c).to_numpy()]) for x, c in ((scores[old], "score"), (names[old], "vec_id"), (np.nonzero(old)[0], "place")))
        order = np.lexsort((name, ~score, place))  # ~ turns the order of all 64-bit integers round
        score, name, place = score[order], name[order], place[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        few = rank < k
        scores, names = np.zeros((2, n, k), np.int64)
        scores[place[few], rank[few]], names[place[few], rank[few]] = score[few], name[few]
        has = np.bincount(place[few], minlength=n)
        floors = np.where(has == k, scores[:, k - 1].astype(np.float64), -np.inf)
        best = np.concatenate([scores.reshape(-1), names.reshape(-1), has]).astype(np.int64)
        return pa.table({"block": held.column("block"), "ids": held.column("ids"), "x": held.column("x"), "best": [best.tobytes()], "floors": [floors.tobytes()]})

    done, until = 0, 1
    while done < n_blocks:
        reach = state.select("block", "x", "floors").mapInArrow(reaches, "query_block long, reach double")
        # a row for each pair of blocks, none for pairs of rows: a query block names the candidate blocks, which bring their length
        named = reach.withColumn("candidate_block", F.explode(F.sequence(F.lit(done).cast("long"), F.lit(min(until, n_blocks) - 1).cast("long"))))
        pairs = stage(named.join(lengths, "candidate_block").filter(F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("reach")).select("candidate_block", "query_block"), "block-pairs")
        if pairs.isEmpty():
            break  # nor can any later block, whose vectors are shorter
        left = candidates.select(F.col("block").alias("candidate_block"), "ids", "x")
        right = state.select(F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("x").alias("query_x"), "floors")
        met = pairs.join(left, "candidate_block").join(right, "query_block").mapInArrow(meet, "query_block long, place long, vec_id long, score long")
        order = Window.partitionBy("query_block", "place").orderBy(F.desc("score"), "vec_id")
        found = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")
        state = stage(state.groupBy("block").cogroup(found.groupBy("query_block")).applyInArrow(tighten, state.schema), "query-blocks")
        done, until = until, until * GROWTH

    def results(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                scores, names, has = _unpacked(r["best"], len(ids), k)
                i, rank = np.nonzero(np.arange(k) < has[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array((rank + 1).astype(np.int32)), pa.array(names[i, rank]), pa.array(scores[i, rank])], ["query_id", "rank", "vec_id", "score"])

    return state.select("ids", "best").mapInArrow(results, "query_id long, rank int, vec_id long, score long")


def _unpacked(best: bytes, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best scores and ids of n queries, and how many each has of them."""
    flat = np.frombuffer(best, np.int64)
    return flat[: n * k].reshape(n, k), flat[n * k : 2 * n * k].reshape(n, k), flat[2 * n * k :]


def _numbered(rows: DataFrame, size: int) -> DataFrame:
    """(id, x, block): stretches of `size` rows in order of descending length, numbered from 0."""
    ordered = rows.repartitionByRange(F.desc("length2"), "id").sortWithinPartitions(F.desc("length2"), "id")
    # the high bits of n are the partition, the low 33 the row's place in it
    placed = stage(ordered.withColumn("n", F.monotonically_increasing_id()).withColumn("part", F.shiftright("n", 33)), "ordered-vectors")
    counts = placed.groupBy("part").count().orderBy("part").collect()  # a row for each partition
    starts, at = [], 0
    for r in counts:
        starts.append((r.part, at))
        at += r["count"]
    begins = rows.sparkSession.createDataFrame(starts, "part long, begin long")
    numbered = placed.join(F.broadcast(begins), "part")
    return numbered.withColumn("block", F.floor((F.col("begin") + F.col("n").bitwiseAND((1 << 33) - 1)) / size)).select("id", "x", "block")
