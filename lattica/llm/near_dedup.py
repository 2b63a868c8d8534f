"""Near-duplicate groups by b-bit MinHash.

A document's set holds its distinct word shingles as 64-bit hashes. K hash functions of the set give minima; bands of
R minima give candidates, and the lowest bits of all K minima, packed, estimate a candidate pair's similarity: two
unlike minima agree in b bits with chance 2^-b, so similarity = (agreeing share - 2^-b) / (1 - 2^-b). Pairs
whose estimate lies far under the threshold go; the rest are confirmed on full sets.

Equal sets are one class from the start, so exact copies meet in no band. Only components are asked for, so pairs
inside one component need no look. First every bucket's smallest member meets the others, which links most groups.
Buckets whose members are one component then are done. Of the others, small ones give their pairs across components.
Of larger ones (loose groups of many near copies) the middlemost members meet all others; what is still apart goes to an exact join by rare shingles: in the order of how few members
have a shingle, two sets at the threshold share one among their first few, at places that leave room for the overlap they need.
So no bucket gives all its pairs, and no pair of a bucket that might be a link is passed over.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.traversal import component_labels

from .shared import stage, text_slices
from .words import UNSPACED, Words, inside_texts, mix, windows, words

#: Members of a crowded bucket that meet all others first.
MIDDLES = 2
#: Members of a bucket whose pairs are made; those of larger ones meet by rare shingles.
SMALL_BUCKET = 32

SIGNATURE = "doc_id long, n_shingles long, set_digest binary, text_digest binary, bits binary, bands array<long>"


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and the n + 1 offsets of the texts' sets."""
    begins, counts = inside_texts(w.offsets, size)
    hashes = windows(w.hashes, size)[begins] if len(w.hashes) >= size else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(counts)), counts)
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        whole = [windows(w.hashes[w.offsets[k] : w.offsets[k + 1]], int(w.counts[k]))[0] for k in short]
        hashes, text = np.concatenate([hashes, np.array(whole, np.uint64)]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        hashes, text = hashes[order], text[order]
    ends = np.searchsorted(text, np.arange(len(counts) + 1))
    parts = [np.unique(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else hashes[:0]), np.concatenate([[0], np.cumsum(sizes)])


class MinHash:
    """`bands` of `rows` minima each; `b` low bits of every minimum are kept."""

    def __init__(self, bands: int, rows: int, b: int, seed: int = 20_24):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.b, self.k = bands, rows, b, bands * rows
        self.odd = rng.integers(0, 1 << 32, self.k, np.uint32) | np.uint32(1)
        self.flip = rng.integers(0, 1 << 32, self.k, np.uint32)

    def minima(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """k x texts; every text must have a shingle."""
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.empty((self.k, len(offsets) - 1), np.uint32)
        y = np.empty_like(x)
        for k in range(self.k):
            np.bitwise_xor(x, self.flip[k], out=y)
            np.multiply(y, self.odd[k], out=y)
            out[k] = np.minimum.reduceat(y, offsets[:-1])
        return out

    def signatures(self, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed low bits (texts x bytes) and band keys (texts x bands)."""
        # the minima are small numbers, whose low bits the odd factor leaves uneven; mixing evens them
        mixed = mix(minima.astype(np.uint64) + (np.arange(self.k, dtype=np.uint64) << np.uint64(32))[:, None])
        low = (mixed[:, :, None] >> np.arange(self.b, dtype=np.uint64)) & np.uint64(1)
        bits = np.packbits(low.astype(np.uint8).transpose(1, 0, 2).reshape(minima.shape[1], -1), axis=1)
        keys = np.zeros((self.bands, minima.shape[1]), np.uint64)
        for r in range(self.rows):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + mixed[r :: self.rows])
        return bits, keys.T.astype(np.int64)

    def agreeing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of packed signatures (pairs x bytes), how many of the k minima agree in all kept bits."""
        differ = np.unpackbits(a ^ b, axis=1)[:, : self.k * self.b].reshape(len(a), self.k, self.b)
        return self.k - differ.any(2).sum(1)

    def estimate(self, agreeing: np.ndarray) -> np.ndarray:
        """The similarity, corrected for low bits that agree by chance."""
        chance = 2.0**-self.b
        return (agreeing / self.k - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, similarity: float = 0.85, shingle: int = 5, bands: int = 36, rows: int = 6, b: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept; text_digest (MD5) and keeper.

    Two documents are linked when the Jaccard similarity of their sets is `similarity` or more, compared in whole
    hundredths. With 36 bands of 6 a pair at 0.85 meets in no band with a chance of 4e-8, and less above. The estimate
    refuses pairs more than six of its deviations below the threshold. A text with fewer words than a
    shingle has its whole sequence as the only one; null, empty and blank texts have none and link with nothing.
    component_id is the smallest doc_id reachable; a null doc_id is never the smallest while another is there. kept
    means doc_id = component_id, so rows that repeat that doc_id are all kept; keeper holds for exactly one row of each
    component, and for every row without shingles. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    hundredths = round(100 * similarity)
    kind = MinHash(bands, rows, b)
    p = similarity + (1 - similarity) * 2.0**-b
    least = kind.k * p - 6 * (kind.k * p * (1 - p)) ** 0.5
    columns = [x.split()[0] for x in SIGNATURE.split(", ")]

    def sign(batches):
        for batch in text_slices(batches):
            w = words(batch.column("text"), UNSPACED, True)
            hashes, offsets = shingle_sets(w, shingle)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            packed, keys = [None] * len(sizes), [None] * len(sizes)
            digests = [hashlib.blake2b(hashes[x:y].tobytes(), digest_size=16).digest() if y > x else None for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            if len(full):
                bits, band_keys = kind.signatures(kind.minima(hashes, np.append(offsets[:-1][full], offsets[-1])))
                for i, k in enumerate(full.tolist()):
                    packed[k], keys[k] = bits[i].tobytes(), band_keys[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), batch.column("text_digest").cast(pa.binary()), pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                columns,
            )

    def text_digest(text):
        return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = texts.withColumn("text_digest", text_digest(F.col("text"))).mapInArrow(sign, SIGNATURE)
    signed = stage(signed.withColumn("row_id", F.monotonically_increasing_id()), "signatures")
    full = signed.filter("n_shingles > 0")
    classes = stage(full.groupBy("set_digest").agg(F.min("row_id").alias("v"), F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("best")), "set-classes")
    chosen = full.join(classes.select("v"), F.col("row_id") == F.col("v"), "left_semi")

    banded = chosen.select(F.col("row_id").alias("v"), F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("v").alias("pivot"), F.max("v").alias("last")).filter("pivot < last").select("bucket", "pivot")
    shared = stage(shared, "shared-buckets")  # as everywhere here: a join of staged sides may split a key of many rows
    members = stage(banded.join(shared, "bucket"), "buckets")
    involved = members.select("v").distinct()
    known = stage(chosen.join(involved, F.col("row_id") == F.col("v"), "left_semi").select(F.col("row_id").alias("v"), "n_shingles", "bits", "doc_id", "text_digest"), "signatures-of-members")

    def sets(batches):
        for batch in text_slices(batches):
            hashes, offsets = shingle_sets(words(batch.column("text"), UNSPACED, True), shingle)
            blobs = [hashes[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(blobs, pa.binary())], ["v", "hashes"])

    # by id and digest, so copies of a text don't meet in one task; a repeated row leaves equal sets, which do no harm
    wanted = known.select("v", F.col("doc_id").alias("wanted_id"), F.col("text_digest").alias("wanted_digest")).hint("shuffle_hash")
    found = texts.withColumn("text_digest", text_digest(F.col("text"))).join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_digest") == F.col("wanted_digest")))
    full_sets = stage(found.select("v", "text").mapInArrow(sets, "v long, hashes binary"), "sets")

    def estimated(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("bits", "bits2"))
            keep = pa.array(kind.agreeing(one, two) >= least)
            yield batch.select(["a", "b"]).filter(keep)

    def confirmed(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("hashes").to_pylist(), batch.column("hashes2").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= hundredths * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def confirm(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that are links."""
        one = known.select(F.col("v").alias("a"), F.col("n_shingles").alias("n"), "bits")
        two = known.select(F.col("v").alias("b"), F.col("n_shingles").alias("n2"), F.col("bits").alias("bits2"))
        near = pairs.distinct().join(one, "a").join(two, "b").filter(F.expr(f"100 * least(n, n2) >= {hundredths} * greatest(n, n2)"))
        near = near.select("a", "b", "bits", "bits2").mapInArrow(estimated, "a long, b long")
        one, two = full_sets.toDF("a", "hashes"), full_sets.toDF("b", "hashes2")
        return near.join(one, "a").join(two, "b").mapInArrow(confirmed, "a long, b long")

    links = stage(confirm(members.filter("v > pivot").select(F.col("pivot").alias("a"), F.col("v").alias("b"))), "links")
    labels = component_labels(links.toDF("a", "b"), stage)

    rest = stage(members.join(labels.toDF("v", "label"), "v", "left").select("bucket", "v", "pivot", F.coalesce("label", "v").alias("label")), "bucket-labels")
    open_ = rest.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("size")).filter("least < most and size > 2")
    open_ = stage(open_.select("bucket", "size"), "bucket-sizes")
    rest = stage(rest.join(open_, "bucket"), "open-buckets")
    one = rest.filter(f"size <= {SMALL_BUCKET} and v > pivot")
    two = one.select("bucket", F.col("v").alias("b"), F.col("label").alias("label_b"))
    more = one.select("bucket", F.col("v").alias("a"), "label").join(two, "bucket").filter("a < b and label <> label_b").select("a", "b")
    crowded = rest.filter(f"size > {SMALL_BUCKET}")
    some_crowded = not crowded.isEmpty()
    if some_crowded:
        each, often = _crowd_shingles(crowded.select("v").distinct(), full_sets)
        # members with the commonest shingles are near the middle of their group and link much of it
        middle = stage(each.join(often, "shingle").groupBy("v").agg(F.avg("often").alias("score")), "crowd-middles")
        order = Window.partitionBy("bucket").orderBy(F.desc("score"), "v")
        middles = crowded.join(middle, "v").withColumn("rank", F.row_number().over(order)).filter(f"rank <= {MIDDLES}")
        middles = stage(middles.select("bucket", F.col("v").alias("a"), F.col("label").alias("label_a")), "middles")
        more = more.unionByName(crowded.join(middles, "bucket").filter("label <> label_a").select(F.least("a", "v").alias("a"), F.greatest("a", "v").alias("b")))
    links = stage(links.unionByName(confirm(more)), "links")
    labels = component_labels(links.toDF("a", "b"), stage)
    if some_crowded:
        crowd = crowded.select("v").distinct().join(labels.toDF("v", "label"), "v", "left").select("v", F.coalesce("label", "v").alias("label"))
        apart = stage(_by_rare_shingles(stage(crowd, "crowd"), each, often, hundredths), "pairs-apart")
        if not apart.isEmpty():
            links = stage(links.unionByName(confirm(apart)), "links")
            labels = component_labels(links.toDF("a", "b"), stage)

    labelled = classes.join(labels.toDF("v", "label"), "v", "left").withColumn("label", F.coalesce("label", "v"))
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"), F.min("best").alias("best"))
    named = labelled.select("set_digest", "label").join(smallest, "label").select("set_digest", "component_id", F.col("best")["row_id"].alias("best_row"))
    named = stage(named, "components-of-sets")  # so that the join may split a set of many rows
    rows_ = signed.select("doc_id", "n_shingles", "set_digest", "text_digest", "row_id").join(named, "set_digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    rows_ = rows_.withColumn("component_id", component).withColumn("keeper", (F.col("n_shingles") == 0) | (F.col("row_id") == F.col("best_row")))
    return rows_.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"), "text_digest", "keeper")


def _crowd_shingles(crowd: DataFrame, full_sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, n, shingle) of all members (v), and (shingle, often): how many of them have it."""

    def shingles(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                hashes = np.frombuffer(batch.column("hashes")[k].as_py(), np.int64)
                own = pa.array(np.full(len(hashes), batch.column("v")[k].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(hashes), len(hashes), np.int64)), pa.array(hashes)], ["v", "n", "shingle"])

    # a repeated row may have left its set twice
    each = crowd.join(full_sets, "v").dropDuplicates(["v"]).select("v", "hashes").mapInArrow(shingles, "v long, n long, shingle long")
    each = stage(each, "crowd-shingles")
    return each, stage(each.groupBy("shingle").agg(F.count("*").alias("often")), "shingle-counts")  # staged, so that a join may split a common one


def _by_rare_shingles(crowd: DataFrame, each: DataFrame, often: DataFrame, hundredths: int) -> DataFrame:
    """(a, b) of all pairs of crowd (v, label) that may reach the similarity and differ in label.

    In an order that all sets share, sets of sizes m and n with the similarity have an overlap of at least
    need = ceil(s * (m + n) / (1 + s)), so the first shingle they share lies where at least need - 1 follow on either side.
    Rare shingles come first, so what a copy has changed stands in front and common shingles seldom count.

    A shingle brings the pairs of its holders only where it is among the rarest of both, at places that leave room, and where one of them
    is in a small component or both are in unlike large ones: after the rounds before, nearly all of a crowd is one component, whose members
    don't meet each other.
    """
    order = Window.partitionBy("v").orderBy("often", "shingle")
    placed = each.join(often, "shingle").withColumn("place", F.row_number().over(order))
    first = placed.filter(f"often > 1 and place <= n - ceil({hundredths} * n / 100) + 1").select("shingle", "v", "n", "place").join(crowd, "v")
    sizes = stage(crowd.groupBy("label").agg(F.count("*").alias("of_label")), "crowd-labels")
    first = stage(first.join(sizes, "label"), "rare-shingles")
    fits = f"""label <> label2 and 100 * least(n, n2) >= {hundredths} * greatest(n, n2)
        and least(n - place, n2 - place2) + 1 >= ceil({hundredths} * (n + n2) / {100 + hundredths})"""
    other = first.toDF("label2", "shingle", "v2", "n2", "place2", "of_label2")
    # members of large components needn't meet each other unless there are several
    small = first.filter(f"of_label <= {SMALL_BUCKET}")
    pairs = small.join(other, "shingle").filter(fits)
    large = sizes.filter(f"of_label > {SMALL_BUCKET}").limit(2).count()
    if large > 1:
        pairs = pairs.unionByName(first.filter(f"of_label > {SMALL_BUCKET}").join(other.filter(f"of_label2 > {SMALL_BUCKET}"), "shingle").filter(fits))
    return pairs.select(F.least("v", "v2").alias("a"), F.greatest("v", "v2").alias("b")).distinct()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns of whatever names, that near_duplicates makes keepers: one of each component.

    Rows without shingles all stay. Where rows repeat both id and text, one of them stays.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    key, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    marked = stage(near_duplicates(plain, id_col=key, text_col=text, **options), "marked-documents")
    keepers = marked.filter("keeper").select(F.col("doc_id").alias("keeper_id"), F.col("text_digest").alias("keeper_digest"), (F.col("n_shingles") == 0).alias("blank")).distinct()
    repeated = not marked.filter("n_shingles > 0").groupBy("doc_id", "text_digest").count().filter("count > 1").isEmpty()
    digested = plain.withColumn("own_digest", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    on = F.col(key).cast("long").eqNullSafe(F.col("keeper_id")) & (F.col("own_digest") == F.col("keeper_digest"))
    out = digested.join(keepers.hint("shuffle_hash"), on)
    if repeated:
        out = out.filter("not blank").dropDuplicates([key, "own_digest"]).unionByName(out.filter("blank"))
    return out.select(*names).toDF(*docs.columns)
