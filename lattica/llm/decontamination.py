"""Benchmark decontamination by a generalised suffix automaton of the items' words.

The automaton holds every run of words of every item. Documents stream through it word by word: each position gets the
longest match that ends there, so every window of an item that occurs in a document is seen, and the state tells the
items. Words that no item has reset it, so only runs of known words that are long enough for a window stream, many
runs side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage, text_slices
from .words import ALPHANUMERIC, words

#: Bytes of items in one automaton, which is broadcast (some 20 MB), and automata that one pass over the documents holds.
ITEM_BYTES, PASS_AUTOMATA = 1 << 20, 8
#: Words that a lane streams before its run goes on in another lane.
LANE = 256


class Automaton:
    """Suffix automaton of all items. State 0 is the empty run; `link` and `length` are the usual ones."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        w = words(pa.array([t for _, t in items], pa.string()), ALPHANUMERIC, True)
        self.vocabulary = np.unique(w.hashes)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        tokens = np.searchsorted(self.vocabulary, w.hashes).tolist()
        ranges = [(int(a), int(b)) for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
        self.item_ids = [k for k, _ in items]
        self.least_run = min([min(window, b - a) for a, b in ranges if b > a], default=window)
        go: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        for a, b in ranges:
            last = 0
            for c in tokens[a:b]:
                last = _extend(go, link, length, last, c)
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        self._store(go)
        self._name(go, tokens, ranges)

    def _store(self, go: list[dict[int, int]]) -> None:
        """Transitions in an open-addressed table: key state * words + word, -1 where empty."""
        self.width = max(1, len(self.vocabulary))
        pairs = [(s * self.width + c, t) for s, moves in enumerate(go) for c, t in moves.items()]
        size = 1 << max(4, (2 * len(pairs)).bit_length())
        self.mask = size - 1
        keys, to = [-1] * size, [0] * size
        for key, t in pairs:
            slot = (key * 0x9E3779B97F4A7C15 >> 20) & self.mask
            while keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            keys[slot], to[slot] = key, t
        self.keys, self.to = np.array(keys, np.int64), np.array(to, np.int32)

    def _name(self, go: list[dict[int, int]], tokens: list[int], ranges: list[tuple[int, int]]) -> None:
        """`capped`: the state of a state's last `window` words; `item`: the first item with those words, `more`: its others; `whole`: shorter items that end there."""
        self.capped = np.full(len(self.link), -1, np.int32)
        self.item = np.full(len(self.link), -1, np.int32)
        for s in np.argsort(self.length, kind="stable").tolist()[1:]:
            if self.length[s] >= self.window:
                up = self.link[s]
                self.capped[s] = self.capped[up] if self.length[up] >= self.window else s
        self.more: dict[int, list[int]] = {}
        ends: dict[int, list[tuple[int, int]]] = {}
        for k, (a, b) in enumerate(ranges):
            s = 0
            for i, c in enumerate(tokens[a:b]):
                s = go[s][c]
                if i + 1 >= self.window:
                    q = int(self.capped[s])
                    if self.item[q] < 0:
                        self.item[q] = k
                    elif self.item[q] != k and k not in self.more.setdefault(q, []):
                        self.more[q].append(k)
            if 0 < b - a < self.window:
                ends.setdefault(s, []).append((b - a, k))
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for s in np.argsort(self.length, kind="stable").tolist()[1:]:
            if found := ends.get(s, []) + self.whole.get(int(self.link[s]), []):
                self.whole[s] = found
        self.has_whole = np.zeros(len(self.link), bool)
        self.has_whole[list(self.whole)] = True

    def step(self, state: np.ndarray, matched: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and longest match after one more (known) word in each lane."""
        state, matched = state.copy(), matched.copy()
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo] * self.width + word[todo]
            slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & self.mask
            found = self.keys[slot]
            while len(other := np.flatnonzero((found != key) & (found >= 0))):
                slot[other] = (slot[other] + 1) & self.mask
                found[other] = self.keys[slot[other]]
            hit = found == key
            state[todo[hit]] = self.to[slot[hit]]
            matched[todo[hit]] += 1
            todo = todo[~hit]
            at_root = state[todo] == 0
            matched[todo[at_root]] = 0
            todo = todo[~at_root]
            state[todo] = self.link[state[todo]]
            matched[todo] = self.length[state[todo]]
        return state, matched

    def stream(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Which words are hit, and (word's place, item) of windows that end there, each item once per lane at least."""
        hit = np.zeros(len(hashes) + 1, np.int64)
        pairs: list[tuple[int, int]] = []
        if not len(self.vocabulary) or not len(hashes):
            return hit[:-1] > 0, pairs
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        known = np.full(len(hashes), -1, np.int64)
        same = self.vocabulary[at] == hashes[maybe]
        known[maybe[same]] = at[same]
        # runs of known words within one text
        inside = np.append(known >= 0, False)
        breaks = np.zeros(len(hashes) + 1, bool)
        breaks[offsets] = True
        begins = np.flatnonzero(inside & (breaks | ~np.append(False, inside[:-1])))
        ends = np.flatnonzero(inside[:-1] & (breaks[1:] | ~inside[1:])) + 1
        long = ends - begins >= self.least_run
        begins, ends = begins[long], ends[long]
        pieces = -(-(ends - begins) // LANE)
        index = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, last = np.repeat(begins, pieces), np.repeat(ends, pieces)
        begins, ends = np.maximum(first, first + index * LANE - (self.window - 1)), np.minimum(last, first + (index + 1) * LANE)
        order = np.argsort(begins - ends, kind="stable")
        begins, ends = begins[order], ends[order]
        state, matched = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        size, live, k = ends - begins, len(begins), 0
        spans: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            live = int(np.searchsorted(-size, -k, side="left"))
            if not live:
                break
            place = begins[:live] + k
            state, matched = self.step(state[:live], matched[:live], known[place])
            full = np.flatnonzero(matched >= self.window)
            if len(full):
                spans.append((place[full] + 1 - matched[full], place[full] + 1))
                own = self.capped[state[full]]
                pairs += zip(place[full].tolist(), self.item[own].tolist(), strict=True)
                if self.more:
                    pairs += [(p, item) for q, p in zip(own.tolist(), place[full].tolist(), strict=True) for item in self.more.get(q, ())]
            for lane in np.flatnonzero(self.has_whole[state]).tolist():
                for n, item in self.whole[int(state[lane])]:
                    if matched[lane] >= n:
                        spans.append((place[lane : lane + 1] + 1 - n, place[lane : lane + 1] + 1))
                        pairs.append((int(place[lane]), item))
            k += 1
        for a, b in spans:
            np.add.at(hit, a, 1)
            np.add.at(hit, b, -1)
        return np.cumsum(hit[:-1]) > 0, pairs


def _extend(go: list[dict[int, int]], link: list[int], length: list[int], last: int, c: int) -> int:
    """Append word c to the item that ends in state `last`; the state of the longer item."""

    def split(p: int, q: int) -> int:
        clone = len(go)
        go.append(dict(go[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and go[p].get(c) == q:
            go[p][c] = clone
            p = link[p]
        return clone

    if c in go[last]:  # an earlier item has this run
        q = go[last][c]
        return q if length[q] == length[last] + 1 else split(last, q)
    new = len(go)
    go.append({})
    link.append(0)
    length.append(length[last] + 1)
    p = last
    while p >= 0 and c not in go[p]:
        go[p][c] = new
        p = link[p]
    if p >= 0:
        q = go[p][c]
        link[new] = q if length[q] == length[p] + 1 else split(p, q)
    return new


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float | None = None, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", with_text: bool = False, keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, item_ids (sorted), contaminated, and what `keep` names.

    Words are runs of ASCII digits, ASCII letters (lower-cased) and all non-ASCII signs. A window is `window` words in a
    row of an item, or a whole shorter item. with_text adds `clean_text`: the text without its hit words and what lies between
    them, with a line end in each gap; equal to the text where nothing is hit. max_coverage drops rows with a larger share of
    hit words. Null and wordless texts have no words and are clean (clean_text of null stays null); items without words match
    nothing; repeated items and rows count each; an empty item table leaves all clean. Columns of `keep` that bear a name above stay as they are, each in its place.

    Items beyond ITEM_BYTES lie in several automata, of which a pass holds PASS_AUTOMATA; every further pass reads the texts, but returns only what it has found.
    """
    spark = docs.sparkSession
    keep = keep or []
    items = items.select(F.col(item_id_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).filter("item is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // ITEM_BYTES))
    kept = [f"k{i}" for i in range(len(keep))]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)))
    several = groups > PASS_AUTOMATA
    if several:
        texts = stage(texts.withColumn("row_id", F.monotonically_increasing_id()), "numbered-documents")
    held = []
    for group in range(groups):
        part = items.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == group) if groups > 1 else items
        held.append(spark.sparkContext.broadcast(Automaton([(r.item, r.text) for r in part.collect()], window)))  # of ITEM_BYTES, by the groups
    found_schema = "spans array<struct<a:int,b:int>>, item_ids array<string>"
    carried = ["doc_id", *(["text"] if with_text else []), *kept, *["row_id"] * several]

    cut_at_once = with_text and not several  # one Python worker a task then serves both

    def matcher(some, names: list[str], all_rows: bool):
        def match(batches):
            automata = [h.value for h in some]
            for batch in batches:
                found_spans: list[list] = [[] for _ in range(batch.num_rows)]
                found_items: list[set] = [set() for _ in range(batch.num_rows)]
                counts = np.zeros(batch.num_rows, np.int64)
                numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], ["row", "text"])
                for part in text_slices([numbered]):
                    base = part.column("row")[0].as_py()
                    w = words(part.column("text"), ALPHANUMERIC, True)
                    counts[base : base + part.num_rows] = w.counts
                    hit = np.zeros(len(w.hashes), bool)
                    for automaton in automata:
                        one, pairs = automaton.stream(w.hashes, w.offsets)
                        hit |= one
                        for p, item in set(pairs):
                            found_items[base + int(np.searchsorted(w.offsets, p, side="right")) - 1].add(automaton.item_ids[item])
                    for k in np.unique(np.searchsorted(w.offsets, np.flatnonzero(hit), side="right") - 1).tolist():
                        flags = np.diff(np.concatenate([[0], hit[w.offsets[k] : w.offsets[k + 1]].astype(np.int8), [0]]))
                        found_spans[base + k] = [{"a": a, "b": b} for a, b in zip(np.flatnonzero(flags == 1).tolist(), np.flatnonzero(flags == -1).tolist(), strict=True)]
                columns = [
                    *(batch.column(c) for c in names), pa.array(counts), pa.array(found_spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                    pa.array([sorted(x) for x in found_items], pa.list_(pa.string())),
                ]
                out = pa.RecordBatch.from_arrays(columns, [*names, "n_words", "spans", "item_ids"])
                if cut_at_once:
                    out = out.set_column(names.index("text"), "text", _cut(batch.column("text"), found_spans))
                yield out if all_rows else out.filter(pa.array([len(x) > 0 for x in found_items], pa.bool_()))

        schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name in names), "n_words long", found_schema])
        order = [f.name for f in texts.schema if f.name in names]
        return texts.select(*order, *["text"] * ("text" not in order)).mapInArrow(match, schema)

    carried = [f.name for f in texts.schema if f.name in carried]
    found = matcher(held[:PASS_AUTOMATA], carried, True)
    if several:
        rest = [matcher(held[k : k + PASS_AUTOMATA], ["row_id"], False) for k in range(PASS_AUTOMATA, groups, PASS_AUTOMATA)]
        more = rest[0]
        for x in rest[1:]:
            more = more.unionByName(x)
        more = more.groupBy("row_id").agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("item_ids")).alias("more_items"))  # a row for each pass that found something
        found = found.join(stage(more, "matches-of-passes"), "row_id", "left")
        both = lambda a, b, kind: F.concat(a, F.coalesce(b, F.array().cast(kind)))
        found = found.withColumn("spans", _merged(both("spans", "more_spans", "array<struct<a:int,b:int>>"))).withColumn("item_ids", F.array_sort(F.array_distinct(both("item_ids", "more_items", "array<string>"))))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    found = found.withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0)
    if max_coverage is not None:
        found = found.filter(F.col("n_hit") <= max_coverage * F.col("n_words"))
    columns = ["doc_id", "n_words", "n_hit", "item_ids", "contaminated"]
    if not with_text:
        return found.select(*columns, *kept).toDF(*columns, *keep)
    if cut_at_once:
        return found.select(*columns, *kept, "text").toDF(*columns, *keep, "clean_text")
    cuts = found.select(*columns, *kept, "text", "spans")

    def cut(batches):
        for batch in batches:
            names = batch.schema.names[:-2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), _cut(batch.column("text"), batch.column("spans").to_pylist())], [*names, "clean_text"])

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cuts.schema[:-2]) + ", clean_text string"
    return cuts.mapInArrow(cut, out).toDF(*columns, *keep, "clean_text")


def _cut(texts: pa.Array, spans: list[list[dict[str, int]]]) -> pa.Array:
    """The texts without their spans; those without spans as they are."""
    if not any(spans):
        return texts
    out = texts.to_pylist()
    for k, some in enumerate(spans):
        if some:
            out[k] = without_words(out[k], [(s["a"], s["b"]) for s in some])
    return pa.array(out, texts.type)


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without words a to b of each span (ascending) and what lies between them."""
    w = words(pa.array([text]), ALPHANUMERIC, True)
    raw, parts, at = text.encode(), [], 0
    for a, b in spans:
        parts.append(raw[at : w.begins[a]])
        at = int(w.ends[b - 1])
    parts.append(raw[at:])
    return "\n".join(p.decode().strip() for p in parts).strip()


def _merged(spans):
    """Overlapping spans of several automata as disjoint ascending ones."""
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["b"] >= s["a"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)
