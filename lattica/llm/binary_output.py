"""Token ids in blocks of canonical, length-limited Huffman codes.

A block is a byte string that needs nothing but the code lengths:

    magic "HUF1" | u32 documents | u32 ids | u32 step | u32 payload bytes
    u32 x documents: ids of each document | u64 x documents: their ids (signed, two's complement)
    u32 x ceil(ids / step): bit offset of every step-th id in the payload (u64 and magic "HUF2" where 32 bits are too few)
    payload: the codes, most significant bit first, padded to 4 bytes and 8 bytes of zeros

Blocks lie in Parquet, one a row with its place, so any store that Spark reaches holds them and any block
is read alone. The codes come from global counts: package-merge gives lengths of at most `max_bits` (more where so many bits
can't tell all ids of the corpus apart), and canonical order gives the codes, so a file of lengths restores them. Decoding follows all checkpoints of a block
side by side: each is a lane, and a table of 2^max_bits entries gives the id and length at a lane's bit.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.work import shared_path

from .shared import stage, text_slices
from .tokens import Vocabulary, encode_column

HEAD = struct.Struct("<4sIIII")
#: A block's magic, and the type of its checkpoints.
MAGIC = {b"HUF1": "<u4", b"HUF2": "<u8"}
#: Bits of a payload from which on checkpoints take 64 bits.
WIDE = 1 << 32
#: Ids between bit-offset checkpoints, and ids of a block; a longer document is a block of its own.
STEP, BLOCK_IDS = 64, 1 << 18


def code_lengths(counts: dict[int, int], max_bits: int = 16) -> dict[int, int]:
    """Optimal lengths of at most max_bits for ids with a count over 0; a single id gets one bit.

    Huffman's tree serves while it is low enough; else package-merge: max_bits rounds of pairing the
    cheapest packages and merging them with the single ids.
    """
    used = sorted((n, i) for i, n in counts.items() if n > 0)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids need codes of more than {max_bits} bits")
    if len(used) <= 1:
        return {i: 1 for _, i in used}
    heap = [(n, k, k) for k, (n, _) in enumerate(used)]
    heapq.heapify(heap)
    parent, nodes = {}, len(used)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = nodes
        heapq.heappush(heap, (a + b, nodes, nodes))
        nodes += 1
    depth = {nodes - 1: 0}
    for k in range(nodes - 2, -1, -1):
        depth[k] = depth[parent[k]] + 1
    if max(depth[k] for k in range(len(used))) <= max_bits:
        return {i: depth[k] for k, (_, i) in enumerate(used)}
    weights = np.array([n for n, _ in used], np.float64)
    rounds, merged = [], weights
    is_single = np.ones(len(used), bool)
    for _ in range(max_bits - 1):
        rounds.append(is_single)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        merged, is_single = both[order], order < len(weights)
    rounds.append(is_single)
    lengths, take = np.zeros(len(used), np.int64), 2 * len(used) - 2
    for flags in reversed(rounds):
        singles = int(flags[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    return {i: int(n) for (_, i), n in zip(used, lengths, strict=True)}


class Code:
    """Canonical codes of (id, length) pairs: shorter first, then by id."""

    def __init__(self, lengths: dict[int, int]):
        pairs = sorted((n, i) for i, n in lengths.items())
        self.bits = max([n for n, _ in pairs], default=1)
        top = max(lengths, default=0) + 1
        self.code, self.length = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.symbol_at, self.length_at = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.int64)
        code = last = 0
        for n, i in pairs:
            code <<= n - last
            last = n
            self.code[i], self.length[i] = code, n
            self.symbol_at[code << (self.bits - n) : (code + 1) << (self.bits - n)] = i
            self.length_at[code << (self.bits - n) : (code + 1) << (self.bits - n)] = n
            code += 1

    def encode(self, ids: np.ndarray, step: int = STEP) -> tuple[np.ndarray, bytes]:
        """Checkpoints and payload."""
        n = self.length[ids]
        ends = np.cumsum(n)
        at = ends - n
        total = int(ends[-1]) if len(ids) else 0
        words = (total + 31) // 32 + 1
        # each code lies in at most two 32-bit words, and bits never overlap, so sums are unions
        shifted = self.code[ids] << (64 - n - (at & 31)).astype(np.uint64)
        word = at >> 5
        high = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), words)
        high[1:] += np.bincount(word, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words)[:-1]
        return at[::step].astype("<u8" if total >= WIDE else "<u4"), high.astype(np.uint64).astype(">u4").tobytes() + b"\0" * 8

    def decode(self, checkpoints: np.ndarray, payload: bytes, n_ids: int, step: int = STEP) -> np.ndarray:
        words = np.frombuffer(payload, ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((step, len(at)), np.uint32)
        left = np.minimum(step, n_ids - step * np.arange(len(at)))
        mask, shift = np.uint64((1 << self.bits) - 1), 64 - self.bits
        live = len(at)
        for k in range(step):
            if live and left[live - 1] <= k:
                live -= 1  # only the last lane may be short
            p = at[:live]
            peek = ((pairs[p >> 5] >> (shift - (p & 31)).astype(np.uint64)) & mask).astype(np.int64)
            out[k, :live] = self.symbol_at[peek]
            p += self.length_at[peek]
        return out.T.reshape(-1)[:n_ids]


def write_block(code: Code, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, step: int = STEP) -> bytes:
    checkpoints, payload = code.encode(ids, step)
    magic = next(m for m, kind in MAGIC.items() if checkpoints.dtype == kind)
    return HEAD.pack(magic, len(sizes), len(ids), step, len(payload)) + sizes.astype("<u4").tobytes() + doc_ids.astype("<i8").tobytes() + checkpoints.tobytes() + payload


def read_block(code: Code, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids."""
    magic, docs, n_ids, step, size = HEAD.unpack_from(block)
    if magic not in MAGIC:
        raise ValueError("not a block of this format")
    at = HEAD.size
    sizes = np.frombuffer(block, "<u4", docs, at)
    doc_ids = np.frombuffer(block, "<i8", docs, at := at + 4 * docs)
    checkpoints = np.frombuffer(block, MAGIC[magic], -(-n_ids // step), at := at + 8 * docs)
    at += checkpoints.nbytes
    return doc_ids, sizes, code.decode(checkpoints, block[at : at + size], n_ids, step)


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, max_bits: int = 16) -> str:
    """Encode docs and write `codes` (id, bits) and `blocks` (part, before, n_ids, block) below folder.

    Documents lie in ascending order of (id, size, checksum); part and before (ids of the part's earlier
    blocks) give the blocks' order. Null
    text is empty, so its document holds the end id alone; rows with a null id are left out, as they
    have no place in the order; rows with equal ids all stay. Ids are counted over all documents. An empty table gives
    no blocks. Every task also stages the counts of its ids, so the global counts need no pass over them; one shuffle, by ranges of the id.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    vocabulary = Vocabulary(spark, tokenizer_path)
    narrow = max(end_id + 1, vocabulary.size) <= 1 << 16  # staged ids then take two bytes
    width = 2 if narrow else 4

    def tokens(batches):
        counts = np.zeros(0, np.int64)
        for batch in text_slices(batches, tokenizing=True):
            flat, offsets = encode_column(batch.column("text"), vocabulary, end_id)
            seen = np.bincount(flat, minlength=len(counts))
            seen[: len(counts)] += counts
            counts = seen
            raw, sizes = flat.astype(f"<u{width}").tobytes(), np.diff(offsets)
            cuts = offsets.tolist()
            ids = [raw[width * x : width * y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            checks = [zlib.crc32(x) for x in ids]  # breaks ties of equal ids
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(checks, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())],
                ["id", "n", "crc", "ids", "counts"],
            )
        if len(counts):  # one more row for each task
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["id", "n", "crc", "ids", "counts"])

    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    staged = stage(texts.mapInArrow(tokens, "id long, n long, crc long, ids binary, counts binary"), "token-ids")

    def histogram(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                more = np.frombuffer(blob, "<i8")
                if len(more) > len(total):
                    total = np.pad(total, (0, len(more) - len(total)))
                total[: len(more)] += more
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["token", "n"])

    counted = staged.select("counts").filter("counts is not null").mapInArrow(histogram, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = {r.token: r.n for r in counted.collect()}  # a row for each id of the vocabulary
    lengths = code_lengths(counts, max(max_bits, len(counts).bit_length()))
    spark.createDataFrame(sorted(lengths.items()), "token long, bits int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/codes")

    def blocks(batches):
        from pyspark import TaskContext

        code, part, before = Code(lengths), TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        keys: list[int] = []
        held = 0

        def flush():
            sizes = np.array([len(b) // width for b in ids], np.int64)
            block = write_block(code, np.array(keys, np.int64), sizes, np.frombuffer(b"".join(ids), f"<u{width}"))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([before], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.array([block], pa.binary())], ["part", "before", "n_ids", "block"])

        for batch in batches:
            for key, blob in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if held and held + len(blob) // width > BLOCK_IDS:
                    yield flush()
                    ids, keys, held, before = [], [], 0, before + held
                ids.append(blob)
                keys.append(key)
                held += len(blob) // width
        if ids:
            yield flush()

    ordered = staged.filter("id is not null").select("id", "n", "crc", "ids").repartitionByRange("id", "n", "crc").sortWithinPartitions("id", "n", "crc").select("id", "ids")
    ordered.mapInArrow(blocks, "part long, before long, n_ids long, block binary").write.mode("overwrite").option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def read_tokens(spark, folder: str, with_ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    if with_ids, ids (little-endian unsigned 32-bit, the end id included)."""
    codes = spark.read.schema("token long, bits int").parquet(f"{folder}/codes")
    lengths = {r.token: r.bits for r in codes.collect()}  # a row for each id of the vocabulary
    blocks = spark.read.schema("part long, before long, n_ids long, block binary").parquet(f"{folder}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).orderBy("part").collect()  # a row for each part file
    starts, at = {}, 0
    for r in sizes:
        starts[r.part] = at
        at += r.n_ids
    held = spark.sparkContext.broadcast(starts)

    def decode(batches):
        code = Code(lengths)
        for batch in batches:
            for part, before, block in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("block").to_pylist(), strict=True):
                keys, n, ids = read_block(code, block)
                n = n.astype(np.int64)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(n)
                parts = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                columns = [pa.array(keys, pa.int64()), pa.array(held.value[part] + before + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(b) for b in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.select("part", "before", "block").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
