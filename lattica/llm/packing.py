"""Best-fit packing by exact-complement hashing.

The plan needs only how many pieces each length has: at most `capacity` numbers, whatever the corpus. It is made in two passes
over the lengths from the longest down. In the first, the gap that a piece leaves is looked up in an index of the available
lengths and of the sums of two of them, and so of three (a length and an indexed pair); a combination that fills it exactly is consumed, and
a length whose gap none fills is set aside. A set-aside length is part of no later combination, which would have been its own.
The second pass packs the residuals by best fit: the longest that fits the gap, again and again, unless the index has an exact
end for it. A sequence is repeated as often as its lengths last: one run of the plan, `times` sequences alike. A run uses up a length or all but one of its pieces, so the plan has a few runs per length.

Pieces meet the plan by rank: the r-th piece of a length takes the r-th place that the plan holds for it. Ranks are
counted per (task, length) where texts are encoded, and put behind those of earlier tasks by a running sum
over the tasks' counts, so no length is gathered in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage, text_slices
from .tokens import Vocabulary, encode_column

PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, task long, place long"


class Sums:
    """How many pieces there are of each length, and in how many ways two lengths that are available make each sum."""

    def __init__(self, have: np.ndarray):
        self.have, self.capacity = have.copy(), len(have) - 1
        there = (have > 0).astype(np.int64)
        twice = np.zeros(self.capacity + 1, np.int64)
        half = self.capacity // 2
        twice[0 : 2 * half + 1 : 2] = there[: half + 1]
        self.pairs = (np.convolve(there, there)[: self.capacity + 1] - twice) // 2
        twice[0 : 2 * half + 1 : 2] = have[: half + 1] >= 2
        self.pairs += twice

    def take(self, length: int, n: int = 1) -> None:
        before, left = int(self.have[length]), int(self.have[length]) - n
        self.have[length] = left
        if left < 2 <= before and 2 * length <= self.capacity:
            self.pairs[2 * length] -= 1
        if left == 0 < before:
            self.pairs[length + 1 :] -= self.have[1 : self.capacity + 1 - length] > 0

    def fill(self, gap: int) -> list[int]:
        """One, two or three available lengths whose sum is the gap, the fewest and then the longest first; or none."""
        if self.have[gap]:
            return [gap]
        if gap > 1 and self.pairs[gap] > 0:
            return self._pair(gap)
        first = np.arange(gap - 2, 0, -1)
        for x in first[(self.have[first] > 0) & (self.pairs[gap - first] > 0)].tolist():
            if pair := self._pair(gap - x, x):  # x itself may be all that the pair has
                return [x, *pair]
        return []

    def _pair(self, total: int, spent: int = 0) -> list[int]:
        """Two available lengths of this sum beside a spent one, the longer first, or none."""
        half = total // 2
        have = self.have[: total + 1].copy()
        if 0 < spent <= total:
            have[spent] -= 1
        both = (have[1 : half + 1] > 0) & (have[total - half : total][::-1] > 0)
        if total % 2 == 0 and have[half] < 2:
            both[half - 1] = False
        k = int(both.argmax()) if len(both) else 0
        return [total - k - 1, k + 1] if len(both) and both[k] else []

    def longest(self, most: int) -> int:
        """The longest available length up to `most`, 0 if none."""
        free = np.flatnonzero(self.have[: most + 1])
        return int(free[-1]) if len(free) else 0


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths in their order) of each run, for counts of lengths from 1 to capacity."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1 to {capacity}")
        have[length] = n
    runs: list[tuple[int, tuple[int, ...]]] = []

    def repeat(sums: Sums, lengths: list[int]) -> None:
        """The sequence of these lengths, whose pieces have been taken, as often as there are more of them."""
        used = np.bincount(lengths, minlength=capacity + 1)
        of = np.flatnonzero(used)
        more = int((sums.have[of] // used[of]).min())
        for x in of.tolist():
            sums.take(x, more * int(used[x]))
        runs.append((1 + more, tuple(lengths)))

    sums, residual = Sums(have), np.zeros(capacity + 1, np.int64)
    for longest in range(capacity, 0, -1):
        while sums.have[longest]:
            sums.take(longest)
            more = sums.fill(capacity - longest) if longest < capacity else []
            if longest < capacity and not more:
                residual[longest] = 1 + sums.have[longest]
                sums.take(longest, int(sums.have[longest]))
                break
            for x in more:
                sums.take(x)
            repeat(sums, [longest, *more])
    sums = Sums(residual)
    for longest in range(capacity, 0, -1):
        while sums.have[longest]:
            lengths, gap = [longest], capacity - longest
            sums.take(longest)
            while gap:
                more = sums.fill(gap) or [sums.longest(gap)]
                if not more[0]:
                    break
                for x in more:
                    sums.take(x)
                lengths += more
                gap -= sum(more)
            repeat(sums, lengths)
    return runs


def _places(runs: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the ranks at which its slots begin, and each slot's first sequence and offset."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    begun: dict[int, int] = {}
    sequence = 0
    for times, lengths in runs:
        offset = 0
        for x in lengths:
            slots.setdefault(x, []).append((begun.get(x, 0), sequence, offset))
            begun[x] = begun.get(x, 0) + times
            offset += x
        sequence += times
    return {x: tuple(np.array(v, np.int64).T) for x, v in slots.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit;
    only if with_ids), ids_crc32, sequence_id, offset.

    A document's ids are those of its whole text and the end id; only ids beyond `capacity` are cut, into pieces
    of `capacity` and a last shorter one. Null text is empty and so one piece of length 1; a null id stays null; equal
    rows are packed each; an empty table gives no rows; other columns of docs are not read. The texts are encoded once, into a
    staged table; the plan is made on the driver from at most `capacity` counts.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(spark, tokenizer_path)

    def pieces(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in text_slices(batches, tokenizing=True):
            flat, offsets = encode_column(batch.column("text"), vocabulary, end_id)
            raw, rows = flat.astype("<u4").tobytes(), []
            for key, begin, end in zip(batch.column("id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for k, at in enumerate(range(begin, end, capacity)):
                    n = min(capacity, end - at)
                    part = raw[4 * at : 4 * (at + n)]
                    rows.append((key, k, at - begin, n, part, zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    staged = stage(texts.mapInArrow(pieces, PIECES), "pieces")
    per_task = staged.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(_places(plan_runs(counts, capacity)))  # a few numbers per length
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    carried = ["doc_id", "piece", "start", "length", *["ids"] * with_ids, "ids_crc32"]
    ranked = staged.select(*carried, "task", "place").join(offsets, ["task", "length"]).withColumn("rank", F.col("before") + F.col("place"))

    def placed(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                begins, first, at = places.value[int(length[rows[0]])]
                k = np.searchsorted(begins, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = first[k] + rank[rows] - begins[k], at[k]
            kept = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*carried, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {dict(staged.dtypes)[c]}" for c in carried)
    return ranked.select(*carried, "rank").mapInArrow(placed, f"{schema}, sequence_id long, offset long")
