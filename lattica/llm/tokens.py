"""Exact token ids by a public tokenizer, with each distinct piece of text encoded once per worker.

A byte-pair model never merges across pre-tokens, and a pre-token of the byte-level pattern holds white space only
in front of, or as part of, a run of it. So a text may be cut before a white-space character that follows a
non-space one, and its ids are those of the pieces, in order. Where all white space is single blanks and line
ends, a piece is a word with the sign before it; its ids come from the library once and then from a table, which is looked up
for all words of a slice at once. Any other text goes to the library as a whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from .words import UNSPACED, Words, mix, words

#: Entries of a worker's table, which starts anew when it is full (about 50 bytes each), and its slots.
TABLE_ENTRIES, SLOT_BITS = 1_200_000, 21

_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_WORD = re.compile(f"[{_LATIN}]+")
#: A word and the signs behind it; an apostrophe may begin a contraction, so it is none of them.
_WORD_SIGNS = re.compile(rf"([{_LATIN}]+)([!-&(-/:-@\[-`{{-~]+)")


def _byte_marks() -> dict[int, str]:
    """The byte-level stage's sign for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_MARKS = _byte_marks()


class PieceTokenizer:
    """encode(texts) gives what tokenizer.encode(text, add_special_tokens=False).ids gives for each."""

    def __init__(self, file: str | bytes):
        """Of a vocabulary file's path or content."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(file) if isinstance(file, bytes) else Tokenizer.from_file(file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        self.drops_space = _drops_space(spec)
        self.byte_level = _byte_level(spec)
        # whether the model may take a word of Latin letters without the text stages, and signs behind it be cut off
        self.direct = not any(re.fullmatch(rf"[\n{_LATIN}]+|[!-/:-@\[-`{{-~]+", t["content"]) for t in spec.get("added_tokens", []))
        self.signs: dict[str, list[int]] = {}
        self._clear()

    def _clear(self) -> None:
        self.keys, self.entry = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        self.n, self.n_ids = 0, 0
        self.head, self.size = np.zeros(1024, np.uint64), np.zeros(1024, np.int32)
        self.at, self.length = np.zeros(1024, np.int32), np.zeros(1024, np.int32)  # length -1: a piece that can't be cut here
        self.ids = np.zeros(4096, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the n + 1 offsets of the texts' ids; null is empty."""
        w = words(texts, UNSPACED, False)
        n = len(texts)
        if not (self.drops_space or self.byte_level):
            return self._joined([self._whole(t.as_py()) for t in texts])
        blank = ~UNSPACED[w.data]
        if self.drops_space:
            lead = np.zeros(len(w.hashes), np.uint8)
            odd = np.zeros(n, bool)
        else:
            before = np.append(w.data, np.uint8(0))[w.begins - 1]
            before[w.offsets[:-1][(w.counts > 0) & (w.bounds[:-1] == w.begins[np.minimum(w.offsets[:-1], max(0, len(w.begins) - 1))] if len(w.begins) else False)]] = 0
            lead = before
            # runs of white space, white space of other kinds, and white space at a text's end
            strange = blank & (w.data != 0x20) & (w.data != 0x0A)
            strange[1:] |= blank[1:] & blank[:-1]
            total = np.concatenate([[0], np.cumsum(strange)])
            odd = total[w.bounds[1:]] > total[w.bounds[:-1]]
            filled = np.flatnonzero(np.diff(w.bounds))
            odd[filled] |= blank[w.bounds[1:][filled] - 1]
        keys = mix(w.hashes + lead.astype(np.uint64)) | np.uint64(1)
        sizes = (w.ends - w.begins).astype(np.int32)
        eight = np.ndarray(len(w.data) + 1, "<u8", np.append(w.data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
        heads = eight[w.begins] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.minimum(sizes, 8).astype(np.uint64) * np.uint64(8)))
        found = self._find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            _, firsts = np.unique(keys[missing], return_index=True)
            new = missing[firsts]
            if self.n + len(new) > TABLE_ENTRIES:
                self._clear()
                missing = np.arange(len(keys))
                _, new = np.unique(keys, return_index=True)
            self._add(w, new, keys[new], heads[new], sizes[new], lead[new])
            found[missing] = self._find(keys[missing])
        # the hash has met another word, or the piece can't be cut: the text goes to the library
        bad = (self.head[found] != heads) | (self.size[found] != sizes) | (self.length[found] < 0)
        if bad.any():
            odd[np.searchsorted(w.offsets, np.flatnonzero(bad), side="right") - 1] = True
        lengths = np.maximum(self.length[found], 0)
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        ids = self.ids[np.repeat(self.at[found] - ends[:-1], lengths) + np.arange(ends[-1])]
        offsets = ends[w.offsets]
        if odd.any():
            parts = [self._whole(texts[k].as_py()) if odd[k] else ids[offsets[k] : offsets[k + 1]] for k in range(n)]
            return self._joined(parts)
        return ids, offsets

    def _joined(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _whole(self, text: str | None) -> np.ndarray:
        return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entries of keys, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[slot]
            same = held == keys[todo]
            out[todo[same]] = self.entry[slot[same]]
            further = ~same & (held != 0)
            todo, slot = todo[further], (slot[further] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def _add(self, w: Words, places: np.ndarray, keys: np.ndarray, heads: np.ndarray, sizes: np.ndarray, leads: np.ndarray) -> None:
        raw = w.data.tobytes()
        lists = []
        for a, b, lead in zip(w.begins[places].tolist(), w.ends[places].tolist(), leads.tolist(), strict=True):
            lists.append(self._piece(raw[a:b].decode(), chr(lead) if lead else ""))
        flat = np.array([i for x in lists if x is not None for i in x], np.uint32)
        lengths = np.array([-1 if x is None else len(x) for x in lists], np.int32)
        n, m = self.n + len(lists), self.n_ids + len(flat)
        for name, least in (("head", n), ("size", n), ("at", n), ("length", n), ("ids", m)):
            if len(old := getattr(self, name)) < least:
                setattr(self, name, np.concatenate([old, np.zeros(max(least, len(old) * 3 // 2) - len(old), old.dtype)]))
        new = slice(self.n, n)
        self.head[new], self.size[new], self.length[new] = heads, sizes, lengths
        self.at[new] = self.n_ids + np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        self.ids[self.n_ids : m] = flat
        entries, slot = np.arange(self.n, n, dtype=np.int32), (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.n, self.n_ids = n, m
        while len(entries):
            free = self.keys[slot] == 0
            tried = np.flatnonzero(free)
            self.keys[slot[tried]], self.entry[slot[tried]] = keys[tried], entries[tried]  # of those that want a slot the last has it
            left = self.keys[slot] != keys
            entries, keys, slot = entries[left], keys[left], (slot[left] + 1) & ((1 << SLOT_BITS) - 1)

    def _piece(self, word: str, lead: str) -> list[int] | None:
        """The ids of a word with the sign before it; None if its end is white space, where it must not be cut."""
        if self.drops_space:
            lead = ""
        elif word[-1].isspace() or word[-1] == "\u180e":
            return None
        if self.direct and lead != "\n":
            if _WORD.fullmatch(word):
                return self._word(word, lead)
            if m := _WORD_SIGNS.fullmatch(word):
                if m[2] not in self.signs:
                    if len(self.signs) >= 10_000:
                        self.signs.clear()
                    self.signs[m[2]] = self.tokenizer.encode(m[2], add_special_tokens=False).ids
                return self._word(m[1], lead) + self.signs[m[2]]
        return self.tokenizer.encode(lead + word, add_special_tokens=False).ids

    def _word(self, word: str, lead: str) -> list[int]:
        """A word of Latin letters is one pre-token: what the text stages make of it goes straight to the model."""
        text = (lead + (word.lower() if self.drops_space else word)).encode().decode("latin-1").translate(_MARKS)
        return [t.id for t in self.model.tokenize(text)]


def _byte_level(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"]) for t in spec.get("added_tokens", []))
    return plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def _drops_space(spec: dict) -> bool:
    """Whether text is lower-cased and pre-tokens never hold white space (a split by a pattern without it)."""
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"]) for t in spec.get("added_tokens", []))
    split = parts[0] if parts else {}
    pattern = str((split.get("pattern") or {}).get("Regex", ""))
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    usual = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1].get("content") == " "
    return plain and usual and split.get("type") == "Split" and split.get("invert") is True and split.get("behavior") == "Removed" and "[^\\s" in pattern and "(?" not in pattern and " " not in pattern and "|\\s" not in pattern


class Vocabulary:
    """A tokenizer's file, which the driver reads and sends to the executors: they need not see the driver's folders.

    The digest is of the file and the library's version.
    """

    def __init__(self, spark: SparkSession, path: str):
        import tokenizers

        content = Path(path).read_bytes()
        self.digest = hashlib.sha256(tokenizers.__version__.encode() + b"\0" + content).hexdigest()
        self.held = spark.sparkContext.broadcast(content)  # a few megabytes
        ids = tokenizers.Tokenizer.from_buffer(content).get_vocab(with_added_tokens=True).values()
        self.size = max(ids, default=0) + 1  # ids lie below this


_HELD: dict[str, PieceTokenizer] = {}


def tokenizer(vocabulary: Vocabulary) -> PieceTokenizer:
    """One for each vocabulary and Python worker, so the memo outlives a task."""
    if vocabulary.digest not in _HELD:
        _HELD.clear()
        _HELD[vocabulary.digest] = PieceTokenizer(vocabulary.held.value)
    return _HELD[vocabulary.digest]


def release() -> None:
    """Forget the tokenizer that this process holds."""
    _HELD.clear()


def encode_column(texts: pa.Array, vocabulary: Vocabulary, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids (unsigned 32-bit) in a row with end_id after each text's, and the n + 1 offsets; null is empty."""
    ids, offsets = tokenizer(vocabulary).encode(texts)
    return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(offsets))
