"""Removal of repeated passages by compressed FM-indexes.

Two documents that share a window of `window` words share its anchor: the run of `gram` words of least hash in it. So
shards are made by anchor. Only anchors that occur in two documents matter; the words of the windows that have one there, at
most 2 * window - gram, become a segment, and equal segments of an anchor are one row with their smallest document.

An anchor of a passage that very many documents have is a crowd, as its segments differ in the words around the passage. A crowd's
distinct segments are cut by content until it is none: first their windows are dealt out by a second anchor, of which again only those of two documents
matter; then windows of one document alone are cut off, which makes pieces of a passage equal, and what is left is dealt out
by further anchors; should that not do, every window is a shard. A window goes the same way in all segments, so nothing is lost.

Each task builds FM-indexes over the segments of some shards: the Burrows-Wheeler transform in a wavelet matrix, common prefixes in a byte
each, and for each class of suffixes that agree in `window` words the smallest document, as a number of 32 bits. Segments stream back
to front through the index, which gives their matching statistics: the longest match from every word on, at most `window` words, and where
it is full the smallest document in which these words start. A smaller one than the segment's own marks the window.

Exact copies take no part: of equal word sequences only the smallest document is searched, and the
others are covered whole if they have a window at all.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage, text_slices
from .words import UNSPACED, inside_texts, mix, windows, words

#: Words of segments in one index; a shard is never split.
INDEX_WORDS = 400_000
#: Distinct segments beyond which a shard is a crowd.
SHARD_SEGMENTS = 256
#: How a crowd is cut, in this order.
CUTS = ("anchor", "shared", "anchor", "anchor", "anchor", "window")


class WaveletMatrix:
    """Rank queries over a sequence of small numbers, in bit planes with a count for every 64 bits."""

    def __init__(self, values: np.ndarray, top: int):
        self.n, self.levels = len(values), max(1, int(top).bit_length())
        self.planes, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1 > 0
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            plane = np.packbits(padded, bitorder="little").view("<u8")
            self.planes.append(plane)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(plane).astype(np.int64))[:-1]]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value occurs before each place."""
        begin, end = np.zeros(len(at), np.int64), at.astype(np.int64)
        both_value = np.concatenate([value, value])
        both = np.concatenate([begin, end])
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = both >> 6
            below = (np.uint64(1) << (both & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.planes[k][word] & below)
            both = np.where((both_value >> level) & 1 > 0, self.zeros[k] + ones, both - ones)
        return both[len(at) :] - both[: len(at)]


class Marks:
    """A bit for each place, and the marked places around any."""

    def __init__(self, marked: np.ndarray):
        self.n = len(marked)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = marked
        self.plane = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.plane).astype(np.int64)
        self.counts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)
        word = np.arange(len(self.plane)) * 64
        self.last = np.maximum.accumulate(np.where(counts > 0, word + _highest(self.plane), -1)).astype(np.int32)
        ahead = np.where(counts > 0, word + _highest(self.plane & (~self.plane + np.uint64(1))), self.n)
        self.first = np.minimum.accumulate(ahead[::-1])[::-1].astype(np.int32)

    def upto(self, at: np.ndarray) -> np.ndarray:
        """How many places up to each are marked, itself included."""
        word, below = at >> 6, _upto(at)
        return self.counts[word] + np.bitwise_count(self.plane[word] & below)

    def begin(self, at: np.ndarray) -> np.ndarray:
        """The last marked place up to each; place 0 is marked."""
        word = at >> 6
        own = self.plane[word] & _upto(at)
        return np.where(own > 0, (word << 6) + _highest(own), self.last[np.maximum(word - 1, 0)])

    def end(self, at: np.ndarray) -> np.ndarray:
        """The first marked place after each, else n."""
        word = at >> 6
        own = self.plane[word] & ~_upto(at)
        later = np.append(self.first, self.n)[word + 1]
        return np.where(own > 0, (word << 6) + _highest(own & (~own + np.uint64(1))), later)


def _upto(at: np.ndarray) -> np.ndarray:
    """Bits 0 to at % 64."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (at & 63)).astype(np.uint64)


def _highest(x: np.ndarray) -> np.ndarray:
    """The highest bit's place; -1 of 0. A number without its second bit can't round up to the next power."""
    return np.frexp((x & ~(x >> np.uint64(1))).astype(np.float64))[1].astype(np.int64) - 1


class FMIndex:
    """Over segments of symbols (1 to top), each followed by 0; suffixes are in order of their first 2^m >= window symbols,
    which serves all patterns up to `window`."""

    def __init__(self, text: np.ndarray, documents: np.ndarray, window: int):
        self.window, n = window, len(text)
        ranks, size = [text.astype(np.int64)], 1
        while size < window:
            r = ranks[-1]
            later = np.zeros(n, np.int64)
            later[: n - size] = r[size:] + 1
            key = r * (int(r.max(initial=0)) + 2) + later
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) if n else key
            r = np.empty(n, np.int64)
            r[order] = fresh
            ranks.append(r)
            size *= 2
        order = np.argsort(ranks[-1], kind="stable")
        self.top = int(text.max(initial=0))
        self.bwt = WaveletMatrix(text[order - 1], self.top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 1))])
        self.common = self._common_prefixes(ranks, order)
        self.held: dict[int, Marks] = {}
        same = np.flatnonzero(self.common < window)
        names, documents = np.unique(documents, return_inverse=True)
        self.documents = names
        self.least = np.minimum.reduceat(documents[order], same).astype(np.int32) if n else documents.astype(np.int32)

    def _common_prefixes(self, ranks: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """How many symbols each suffix shares with the one before it, `window` at most; the text's end equals nothing."""
        n, common = len(order), np.zeros(len(order), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            r = np.append(ranks[k], np.arange(-1, -n - 2, -1))  # beyond the end nothing is equal
            one, two = order[1:] + common[1:], order[:-1] + common[1:]
            common[1:] += np.where(r[np.minimum(one, 2 * n)] == r[np.minimum(two, 2 * n)], 1 << k, 0)
        return np.minimum(common, self.window).astype(np.uint8 if self.window < 256 else np.uint32)

    def marks(self, depth: int) -> Marks:
        """Where the classes of suffixes begin that agree in `depth` symbols."""
        if depth not in self.held:
            marked = self.common < depth
            marked[:1] = True
            self.held[depth] = Marks(marked)
        return self.held[depth]

    def _further(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes of a range that a symbol precedes, with it: one backward step."""
        ranks = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.before[symbol] + ranks[: len(low)], self.before[symbol] + ranks[len(low) :]

    def _range(self, depth: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if depth == 0:
            return np.zeros(len(at), np.int64), np.full(len(at), self.bwt.n, np.int64)
        return self.marks(depth).begin(at), self.marks(depth).end(at)

    def _shortened(self, symbol: np.ndarray, low: np.ndarray, matched: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For matches that a symbol can't precede: the longest start of each that it can, with it; an empty match where there is none."""
        least, most = np.full(len(low), -1), matched - 1  # the depth lies in between, -1 is none
        while len(todo := np.flatnonzero(least < most)):
            middle = (least[todo] + most[todo] + 1) // 2
            for depth in np.unique(middle).tolist():
                lanes = todo[middle == depth]
                a, b = self._further(symbol[lanes], *self._range(depth, low[lanes]))
                least[lanes[b > a]] = depth
                most[lanes[b <= a]] = depth - 1
        new_low, new_high = np.zeros(len(low), np.int64), np.full(len(low), self.bwt.n, np.int64)
        for depth in np.unique(least).tolist():
            if depth >= 0:
                lanes = np.flatnonzero(least == depth)
                new_low[lanes], new_high[lanes] = self._further(symbol[lanes], *self._range(depth, low[lanes]))
        return new_low, new_high, least + 1

    def matching(self, segments: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of segments of symbols, of which any may be foreign: for each place how many symbols from it on, within its
        segment and up to `window`, the index has in a row; and where that is `window`, the smallest document that has them, else -1. All segments stream side by side, from their ends."""
        sizes = np.diff(offsets)
        lanes = np.argsort(-sizes, kind="stable")
        sizes, ends = sizes[lanes], offsets[1:][lanes]
        length, least = np.zeros(int(offsets[-1]), np.int64), np.full(int(offsets[-1]), -1, np.int64)
        low, high, matched = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.bwt.n, np.int64), np.zeros(len(lanes), np.int64)
        for k in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes, -k, side="left"))
            place = ends[:live] - 1 - k
            symbol = segments[place]
            full = np.flatnonzero(matched[:live] == self.window)
            if len(full):  # one word fewer on the right, then one more on the left
                low[full], high[full] = self._range(self.window - 1, low[full])
                matched[full] -= 1
            known = (symbol > 0) & (symbol <= self.top)
            use = np.where(known, symbol, 0)
            a, b = self._further(use, low[:live], high[:live])
            bad = np.flatnonzero(~known | (b <= a))
            matched[:live] += 1
            if len(bad):
                if len(some := bad[known[bad]]):
                    a[some], b[some], matched[some] = self._shortened(symbol[some], low[some], matched[some] - 1)
                none = bad[~known[bad]]
                a[none], b[none], matched[none] = 0, self.bwt.n, 0
            low[:live], high[:live] = a, b
            length[place] = matched[:live]
            full = np.flatnonzero(matched[:live] == self.window)
            if len(full):
                least[place[full]] = self.documents[self.least[self.marks(self.window).upto(low[full]) - 1]]
        return length, least

    def least_documents(self, segments: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each place of the segments, the smallest document in which the window that starts there starts; -1 where there is none."""
        return self.matching(segments, offsets)[1]


class Anchors(NamedTuple):
    """Stretches of windows that have one anchor, in order: its place and hash, and the first and last window's begin."""

    places: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray
    lasts: np.ndarray


def anchors(hashes: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Anchors:
    """The anchor of a window is its gram of least hash, the first one of equals; every window of a text is in one stretch."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return Anchors(none, none.astype(np.uint64), none, none)
    grams = windows(hashes, gram)
    reach, done = window - gram + 1, 1
    least, place = grams, np.arange(len(grams))

    def lesser(by: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        right = least[by : by + n] < least[:n]
        return np.where(right, least[by : by + n], least[:n]), np.where(right, place[by : by + n], place[:n])

    while 2 * done <= reach:
        least, place = lesser(done, len(least) - done)
        done *= 2
    n = len(grams) - reach + 1
    least, place = lesser(reach - done, n) if reach > done else (least[:n], place[:n])
    begins, _ = inside_texts(offsets, window)
    if not len(begins):
        return Anchors(none, none.astype(np.uint64), none, none)
    own = place[begins]
    # windows of two texts have no anchor in common, and those of one text follow each other
    edges = np.flatnonzero(np.diff(own) != 0) + 1
    first = np.concatenate([[0], edges])
    return Anchors(own[first], grams[own[first]], begins[first], begins[np.append(edges, len(begins)) - 1])


def covered_spans(docs: DataFrame, window: int = 50, gram: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans (disjoint ascending word ranges [a, b) to remove), kept_sha256 (of the words that stay, joined by blanks).

    A word goes if a window that covers it also starts in a document of smaller doc_id. Words are runs without blanks and
    the control characters from tab to carriage return. Null text has no words; a text shorter than a window loses none;
    rows with a null doc_id neither lose words nor take them from others; rows that repeat a doc_id never cover each
    other; an empty table gives no rows; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def scan(batches):
        for batch in text_slices(batches):
            w = words(batch.column("text"), UNSPACED, False)
            found = anchors(w.hashes, w.offsets, window, gram)
            bounds = np.searchsorted(found.firsts, w.offsets)
            signed = found.hashes.astype(np.int64)
            digests = []
            for k in range(batch.num_rows):
                whole = b" ".join(w.data[w.bounds[k] : w.bounds[k + 1]].tobytes().split())  # bytes.split() knows the same white space
                digests.append(hashlib.sha256(whole).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(digests, pa.binary()), pa.array([signed[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.list_(pa.int64()))],
                ["doc_id", "n_words", "words_digest", "anchors"],
            )

    scanned = stage(texts.mapInArrow(scan, "doc_id long, n_words long, words_digest binary, anchors array<long>"), "anchors")
    # of equal word sequences the smallest document; what is found for it holds for rows that repeat its id
    classes = scanned.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).groupBy("words_digest").agg(F.min("doc_id").alias("first_id"))
    classes = stage(classes, "word-classes")
    first = scanned.join(classes, (scanned.words_digest == classes.words_digest) & (F.col("doc_id") == F.col("first_id")), "left_semi")
    occurring = first.select("doc_id", "words_digest", F.explode(F.array_distinct("anchors")).alias("anchor"))
    shared = occurring.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("anchor")
    shared = stage(shared, "anchors-of-two")  # staged, so that the join may split an anchor of many documents
    wanted = stage(occurring.join(shared, "anchor").groupBy("doc_id", "words_digest").agg(F.collect_set("anchor").alias("wanted")), "shared-anchors")  # a row has its own document's anchors

    def cut(batches):
        for batch in text_slices(batches, most=1 << 19):
            w = words(batch.column("text"), UNSPACED, False)
            found = anchors(w.hashes, w.offsets, window, gram)
            bounds = np.searchsorted(found.firsts, w.offsets)
            signed = found.hashes.astype(np.int64)
            rows = []
            for k, (key, digest, wanted_) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("words_digest").to_pylist(), batch.column("wanted"), strict=True)):
                if hashlib.sha256(b" ".join(w.data[w.bounds[k] : w.bounds[k + 1]].tobytes().split())).digest() != digest:
                    continue  # another text under the same id
                of = slice(bounds[k], bounds[k + 1])
                use = np.isin(signed[of], wanted_.values.to_numpy())
                for anchor, a, b in zip(signed[of][use].tolist(), found.firsts[of][use].tolist(), found.lasts[of][use].tolist(), strict=True):
                    rows.append((anchor, key, digest, a - int(w.offsets[k]), w.hashes[a : b + window]))
            if rows:
                yield _segment_rows(rows)

    involved = stage(texts.join(wanted.hint("shuffle_hash"), "doc_id"), "involved-texts")
    segments = stage(involved.mapInArrow(cut, SEGMENT), "segments")
    crowds = _crowds(segments)
    cold = segments.join(crowds, "anchor", "left_anti") if crowds else segments
    distinct = cold.groupBy("anchor", "segment_digest").agg(F.min("doc_id").alias("doc_id"), F.first("segment").alias("segment"))

    least = _least(distinct, window)
    if crowds:
        least = least.unionByName(_least_of_crowds(segments.join(crowds, "anchor", "left_semi"), window, gram))
    marked = segments.drop("segment").join(least, ["anchor", "segment_digest"]).withColumn("starts", F.expr(f"transform(filter(sequence(0, size(least) - 1), i -> size(least) > 0 and least[i] < doc_id), i -> start + i)"))
    spans = marked.filter("size(starts) > 0").groupBy("doc_id", "words_digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))  # of one document's own windows

    def keep(batches):
        for batch in text_slices(batches, most=1 << 22):
            rows = []
            for key, digest, text, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "words_digest", "text", "starts")), strict=True):
                all_words = text.encode().split()
                if hashlib.sha256(b" ".join(all_words)).digest() != digest:
                    continue
                marks, starts = np.zeros(len(all_words) + 1, np.int64), np.array(starts, np.int64)
                np.add.at(marks, starts, 1)
                np.add.at(marks, starts + window, -1)
                gone = np.concatenate([[0], np.cumsum(marks[:-1]) > 0, [0]]).astype(np.int8)
                stay = np.flatnonzero(gone[1:-1] == 0).tolist()
                kept = b" ".join([all_words[i] for i in stay])
                edges = np.diff(gone)
                rows.append((key, digest, [{"a": x, "b": y} for x, y in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)], hashlib.sha256(kept).hexdigest()))
            if not rows:
                continue
            types = [pa.int64(), pa.binary(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "words_digest", "spans", "kept"])

    found = involved.select("doc_id", "words_digest", "text").join(spans.hint("shuffle_hash"), ["doc_id", "words_digest"]).mapInArrow(keep, "doc_id long, words_digest binary, spans array<struct<a:bigint,b:bigint>>, kept string")
    found = found.dropDuplicates(["doc_id", "words_digest"]).toDF("found_id", "found_digest", "spans", "kept")
    rows_ = scanned.select("doc_id", "n_words", "words_digest").join(classes, "words_digest", "left")
    rows_ = rows_.join(found, (F.col("doc_id") == F.col("found_id")) & (F.col("words_digest") == F.col("found_digest")), "left")
    copy = F.col("doc_id") > F.col("first_id")
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_words").alias("b")))
    empty = hashlib.sha256(b"").hexdigest()
    return rows_.select(
        "doc_id", "n_words",
        F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept", F.lower(F.hex("words_digest")))).alias("kept_sha256"),
    )


SEGMENT = "anchor long, segment_digest binary, doc_id long, words_digest binary, start long, segment binary"


def _segment_rows(rows: list[tuple[int, int, bytes, int, np.ndarray]]) -> pa.RecordBatch:
    """Of (anchor, document, digest of its words, place of the first word, words' hashes)."""
    out = []
    for anchor, key, digest, start, hashes in rows:
        segment = hashes.tobytes()
        out.append((anchor, hashlib.blake2b(segment, digest_size=16).digest(), key, digest, start, segment))
    types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in SEGMENT.split(", ")])


def _least(distinct: DataFrame, window: int) -> DataFrame:
    """(anchor, segment_digest, least) of distinct segments (anchor, segment_digest, doc_id, segment): for each window the smallest document of its shard that has it."""

    def search(batches):
        held: list[tuple[int, bytes, int, np.ndarray]] = []
        size = 0

        def flush():
            symbols = np.concatenate([h[3] for h in held])
            lengths = np.array([len(h[3]) for h in held], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            ranked = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
            text = np.insert(ranked, offsets[1:], 0)
            index = FMIndex(text, np.repeat(np.array([h[2] for h in held], np.int64), lengths + 1), window)
            least = index.least_documents(ranked, offsets)
            parts = [least[a : max(a, b - window + 1)] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary()), pa.array(parts, pa.list_(pa.int64()))], ["anchor", "segment_digest", "least"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "segment_digest", "doc_id", "segment")), strict=True):
                if size >= INDEX_WORDS and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append((row[0], row[1], row[2], np.frombuffer(row[3], np.uint64)))
                size += len(held[-1][3])
        if held:
            yield flush()

    sharded = distinct.select("anchor", "segment_digest", "doc_id", "segment").repartition("anchor").sortWithinPartitions("anchor")
    return sharded.mapInArrow(search, "anchor long, segment_digest binary, least array<long>")


def _crowds(segments: DataFrame) -> DataFrame | None:
    """Anchors of more than SHARD_SEGMENTS distinct segments; None where there are none."""
    often = stage(segments.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD_SEGMENTS).select("anchor"), "frequent-anchors")
    if often.isEmpty():
        return None
    distinct = segments.select("anchor", "segment_digest").join(often, "anchor", "left_semi").distinct()
    crowds = stage(distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD_SEGMENTS).select("anchor"), "crowds")
    return None if crowds.isEmpty() else crowds


def _least_of_crowds(segments: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, segment_digest, least) of the segments of crowds, which go through shards of their pieces.

    A piece bears its segment's document, anchor (as whole_anchor) and digest (as words_digest), and its place there (start).
    """
    whole = segments.groupBy("anchor", "segment_digest").agg(F.min("doc_id").alias("doc_id"), F.first("segment").alias("segment"))
    whole = stage(whole, "segments-of-crowds")
    rest = whole.select("anchor", F.col("anchor").alias("whole_anchor"), "segment_digest", "doc_id", F.col("segment_digest").alias("words_digest"), F.lit(0).cast("long").alias("start"), "segment")
    done = []
    for k, how in enumerate(CUTS):
        if how == "shared":
            rest = rest.join(_shared_windows(rest, window), ["anchor", "segment_digest", "whole_anchor", "words_digest"])
        cut = stage(rest.mapInArrow(_cutter(how, k, window, gram), f"{SEGMENT}, whole_anchor long"), "pieces")
        shared = cut.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("anchor")
        pieces = stage(cut.join(stage(shared, "shards-of-two"), "anchor"), "pieces-of-two")
        crowds = _crowds(pieces)
        if not crowds:
            done.append(pieces)
            break
        done.append(pieces.join(crowds, "anchor", "left_anti"))
        rest = pieces.join(crowds, "anchor", "left_semi")
    else:
        done.append(rest)  # single windows: equal ones are one row
    pieces = done[0]
    for part in done[1:]:
        pieces = pieces.unionByName(part)
    distinct = pieces.groupBy("anchor", "segment_digest").agg(F.min("doc_id").alias("doc_id"), F.first("segment").alias("segment"))
    found = pieces.drop("segment", "doc_id").join(_least(distinct, window), ["anchor", "segment_digest"])
    found = found.groupBy(F.col("whole_anchor").alias("anchor"), F.col("words_digest").alias("segment_digest")).agg(F.collect_list(F.struct("start", "least")).alias("parts"))  # a segment's pieces

    def joined(batches):
        for batch in batches:
            least = []
            for doc, size, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "size", "parts")), strict=True):
                own = np.full(size // 8 - window + 1, doc, np.int64)  # windows that no piece has are this document's alone
                for p in parts or ():
                    of = slice(p["start"], p["start"] + len(p["least"]))
                    own[of] = np.minimum(own[of], p["least"])
                least.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("segment_digest"), pa.array(least, pa.list_(pa.int64()))], ["anchor", "segment_digest", "least"])

    sized = whole.select("anchor", "segment_digest", "doc_id", F.octet_length("segment").alias("size"))
    return sized.join(found, ["anchor", "segment_digest"], "left").select("doc_id", "size", "parts", "anchor", "segment_digest").mapInArrow(joined, "anchor long, segment_digest binary, least array<long>")


def _shared_windows(pieces: DataFrame, window: int) -> DataFrame:
    """pieces' keys with `places`: which windows of a piece two documents have, going by two hashes of all their words."""
    key = ["anchor", "segment_digest", "whole_anchor", "words_digest"]

    def each(batches):
        for batch in batches:
            for i, (doc, blob) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("segment").to_pylist(), strict=True)):
                hashes = np.frombuffer(blob, np.uint64)
                one, two = windows(hashes, window).astype(np.int64), windows(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), window).astype(np.int64)
                own = pa.array(np.full(len(one), i))
                columns = [pa.array(one), pa.array(two), pa.array(np.full(len(one), doc), pa.int64()), *(batch.column(c).take(own) for c in key), pa.array(np.arange(len(one), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["one", "two", "doc_id", *key, "place"])

    dealt = stage(pieces.select(*key, "doc_id", "segment").mapInArrow(each, "one long, two long, doc_id long, anchor long, segment_digest binary, whole_anchor long, words_digest binary, place int"), "crowd-windows")
    shared = dealt.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("one", "two")
    return dealt.join(stage(shared, "windows-of-two"), ["one", "two"], "left_semi").groupBy(*key).agg(F.collect_list("place").alias("places"))  # a piece's windows


def _cutter(how: str, k: int, window: int, gram: int):
    """The function that cuts pieces of crowds: by another anchor, after windows of one document are gone, or into windows."""

    def cut(batches):
        salt = mix(np.array([k + 1], np.uint64))
        for batch in batches:
            rows, whole = [], []
            places = batch.column("places").to_pylist() if how == "shared" else [None] * batch.num_rows
            columns = (batch.column(c).to_pylist() for c in ("anchor", "whole_anchor", "doc_id", "words_digest", "start", "segment"))
            for anchor, first_anchor, key, digest, start, blob, some in zip(*columns, places, strict=True):
                hashes = np.frombuffer(blob, np.uint64)
                base = np.array([anchor], np.int64).view(np.uint64)
                if how == "window":
                    names = mix(windows(hashes, window) + base).view(np.int64).tolist()
                    rows += [(name, key, digest, start + i, hashes[i : i + window]) for i, name in enumerate(names)]
                else:
                    some = np.arange(len(hashes) - window + 1) if some is None else np.sort(np.array(some, np.int64))
                    edges = np.flatnonzero(np.diff(some) != 1) + 1
                    for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(some)).tolist(), strict=True):
                        first, last = int(some[a]), int(some[b - 1])
                        part = hashes[first : last + window]
                        found = anchors(mix(part ^ salt), np.array([0, len(part)]), window, gram)
                        names = mix(found.hashes + base).view(np.int64).tolist()
                        rows += [(name, key, digest, start + first + x, part[x : y + window]) for name, x, y in zip(names, found.firsts.tolist(), found.lasts.tolist(), strict=True)]
                whole += [first_anchor] * (len(rows) - len(whole))
            if rows:
                out = _segment_rows(rows)
                yield out.append_column("whole_anchor", pa.array(whole, pa.int64()))

    return cut
