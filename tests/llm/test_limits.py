"""Sizes beyond which operators go another way, made small or passed."""

import numpy as np
import public_tokenizers
import pytest
from test_text_operators import ITEMS, TEXTS, brute_hits, brute_removed, removed

from lattica.llm import binary_output, decontamination, substring_dedup

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("automata", [1, 2])
def test_items_of_several_passes(spark, monkeypatch, automata):
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 60)
    monkeypatch.setattr(decontamination, "PASS_AUTOMATA", automata)
    docs = spark.createDataFrame([(k, t, "a", "b") for k, t in enumerate(TEXTS)], "doc_id long, text string, spans string, row_id string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    out = decontamination.decontaminate(docs, items, window=10, with_text=True, keep=["spans", "row_id"]).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, list(r.item_ids)) for r in out] == brute_hits(TEXTS, [(n, t) for n, t in ITEMS if n is not None], 10)
    assert [(r.spans, r.row_id) for r in out] == [("a", "b")] * len(TEXTS) and out[4].clean_text == "a"


def test_twenty_megabytes_of_items(spark):
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"word{k}" for k in range(20_000)])
    items = [(str(k), " ".join(vocabulary[rng.integers(0, len(vocabulary), 2_500)])) for k in range(820)]
    assert sum(len(t) for _, t in items) > 18_000_000
    texts, want = [], []
    for k in range(0, 820, 41):
        cut = items[k][1].split()[100 : 100 + 8 + k % 4]
        texts.append(f"before {' '.join(cut)} after")
        want.append((len(cut) + 2, len(cut) if len(cut) >= 10 else 0, [str(k)] if len(cut) >= 10 else []))
    docs, table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string").repartition(8)
    out = decontamination.decontaminate(docs, table).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, list(r.item_ids)) for r in out] == want


def test_codes_of_a_large_vocabulary():
    """130,000 distinct ids need more than 16 bits."""
    rng = np.random.default_rng(1)
    x = np.concatenate([np.arange(130_000), (rng.zipf(1.2, 50_000) % 130_000)]).astype(np.uint32)
    counts = dict(enumerate(np.bincount(x).tolist()))
    code = binary_output.Code(binary_output.code_lengths(counts, max(16, len(counts).bit_length())))
    _, _, back = binary_output.read_block(code, binary_output.write_block(code, np.array([3]), np.array([len(x)]), x))
    assert (back == x).all()


def test_blocks_beyond_32_bit_offsets(monkeypatch):
    monkeypatch.setattr(binary_output, "WIDE", 1000)
    x = (np.random.default_rng(2).zipf(1.3, 5000) % 300).astype(np.uint32)
    code = binary_output.Code(binary_output.code_lengths({int(i): int(c) for i, c in enumerate(np.bincount(x)) if c}))
    block = binary_output.write_block(code, np.array([3]), np.array([len(x)]), x)
    assert block[:4] == b"HUF2" and (binary_output.read_block(code, block)[2] == x).all()


def test_files_of_more_ids_than_bits(odd, spark):
    """max_bits too small for the corpus's ids grows."""
    out = binary_output.read_tokens(spark, binary_output.write_tokens(odd, BYTE, max_bits=3)).collect()
    want = {r.doc_id: bytes(r.ids) for r in binary_output.read_tokens(spark, binary_output.write_tokens(odd, BYTE)).collect() if r.doc_id != 7}
    assert {r.doc_id: bytes(r.ids) for r in out if r.doc_id != 7} == want


@pytest.mark.parametrize("limit,cuts", [(3, substring_dedup.CUTS), (1, substring_dedup.CUTS), (2, ("window",)), (2, ("shared",)), (2, ("anchor",))])
def test_crowded_anchors(spark, monkeypatch, limit, cuts):
    """A passage in many contexts, near copies and runs of one word, by each way of cutting crowds."""
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", limit)
    monkeypatch.setattr(substring_dedup, "CUTS", cuts)
    rng = np.random.default_rng(6)
    make = lambda n, top: [f"p{x}" for x in rng.integers(0, top, n)]
    passage, base = make(17, 500), make(60, 500)
    rows = [(k, " ".join([*make(int(rng.integers(0, 20)), 500), *passage, *make(int(rng.integers(0, 20)), 500)])) for k in range(25)]
    for k in range(25):
        copy = list(base)
        copy[int(rng.integers(0, 60))] = f"x{k % 4}"
        rows.append((40 + k, " ".join(copy)))
    rows += [(80 + k, " ".join(["same"] * (12 + k))) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert removed(substring_dedup.covered_spans(docs, window=12, gram=4)) == brute_removed(rows, 12)


def test_matching_statistics_of_foreign_texts():
    rng = np.random.default_rng(9)
    for top, window in ((3, 6), (2, 9), (6, 4)):
        held = [rng.integers(1, top + 1, int(rng.integers(0, 40))) for _ in range(12)]
        docs = rng.integers(0, 9, 12)
        flat = np.concatenate(held).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])])
        index = substring_dedup.FMIndex(np.insert(flat, offsets[1:], 0), np.repeat(docs, np.diff(offsets) + 1), window)
        runs = {}
        for x, d in zip(held, docs):
            for a in range(len(x)):
                for b in range(a + 1, min(len(x), a + window) + 1):
                    run = tuple(x[a:b].tolist())
                    runs[run] = min(runs.get(run, 99), d)
        asked = [rng.integers(0, top + 3, int(rng.integers(0, 60))) for _ in range(20)] + [rng.integers(1, top + 1, 80)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in asked])])
        length, least = index.matching(np.concatenate(asked).astype(np.int64), at)
        for x, a in zip(asked, at):
            for i in range(len(x)):
                n = max([m for m in range(1, window + 1) if i + m <= len(x) and tuple(x[i : i + m].tolist()) in runs], default=0)
                assert length[a + i] == n and least[a + i] == (runs[tuple(x[i : i + n].tolist())] if n == window else -1)
