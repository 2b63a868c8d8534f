import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lattica.llm import binary_output, packing, token_counts
from lattica.llm.tokens import PieceTokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CODERS = {p: PieceTokenizer(p) for p in (BYTE, WORD)}
PLAIN = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def ids(path, text):
    return PLAIN[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aB' .,!\n\t_1é  ́İß日<|>"), st.characters(codec="utf-8"))), max_size=6))
def test_pieces_are_exact(path, texts):
    flat, offsets = CODERS[path].encode(pa.array(texts, pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [ids(path, t) for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("text", ["", "a<|endoftext|> b <|endoftext|>", "I'll we've\n'tis", "x\x1c y᠎ z", "  two\n\nlines ", "ΑΣ ΟΔΟΣ\nΣ"])
def test_special_cases_are_exact(path, text):
    assert CODERS[path].encode(pa.array([text, None, text]))[0].tolist() == ids(path, text) * 2


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr("lattica.llm.tokens.TABLE_ENTRIES", 50)
    coder, rng = PieceTokenizer(BYTE), random.Random(1)
    for _ in range(20):
        text = " ".join("".join(rng.choice("abc") for _ in range(4)) for _ in range(30))
        assert coder.encode(pa.array([text]))[0].tolist() == ids(BYTE, text)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_counts(odd, odd_rows, no_rows, spark, tmp_path):
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second run finds all in the cache
        out = token_counts.count_tokens(odd, BYTE, limit=100, cache_path=cache)
        want = [(i, len((t or "").encode()), len(ids(BYTE, t)), len(ids(BYTE, t)) > 100) for i, t in odd_rows]
        assert by_id(out) == sorted(want, key=str)
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in odd_rows})
    assert token_counts.count_tokens(no_rows, BYTE).count() == 0


def packed(df):
    return df.toPandas().sort_values(["sequence_id", "offset"])


def test_packing(odd, odd_rows, no_rows):
    out = packed(packing.pack(odd, WORD, capacity=512, end_id=1))
    want = []
    for i, t in odd_rows:
        x = np.array([*ids(WORD, t), 1], "<u4")
        want += [(i, k, 512 * k, len(x[a : a + 512]), zlib.crc32(x[a : a + 512].tobytes())) for k, a in enumerate(range(0, len(x), 512))]
    got = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in out.itertuples())
    for _, s in out.groupby("sequence_id"):
        assert s.length.sum() <= 512 and s.offset.tolist() == [0, *s.length.cumsum()[:-1]]
    assert out.sequence_id.nunique() <= max(-(-out.length.sum() // 512), (out.length > 256).sum()) + 1  # no two longer halves fit together
    assert packing.pack(no_rows, WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30)))
def test_plans_place_every_piece_once(counts):
    used: dict[int, int] = {}
    sequences = 0
    for times, lengths in packing.plan_runs(counts, 40):
        assert sum(lengths) <= 40 and times > 0
        sequences += times
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == {k: n for k, n in counts.items() if n}
    total = sum(k * n for k, n in counts.items())
    assert sequences <= 2 * total / 40 + 1  # what opens a sequence fits in none before


def test_exact_complements_are_found():
    assert packing.plan_runs({30: 5, 6: 5, 4: 5}, 40) == [(5, (30, 6, 4))]
    assert sum(t for t, _ in packing.plan_runs({25: 3, 7: 3, 5: 3, 3: 3}, 40)) == 3


def test_lengths_beyond_the_capacity_are_refused():
    with pytest.raises(ValueError):
        packing.plan_runs({41: 1}, 40)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 500), st.integers(0, 10**9), min_size=1, max_size=60), st.integers(6, 9))
def test_code_lengths(counts, most):
    lengths = binary_output.code_lengths(counts, most)
    assert set(lengths) == {i for i, n in counts.items() if n} and all(1 <= n <= most for n in lengths.values())
    assert sum(2.0**-n for n in lengths.values()) <= 1
    if len(lengths) > 1:
        assert sum(2.0**-n for n in lengths.values()) == 1
        free = binary_output.code_lengths(counts, 60)
        cost = lambda x: sum(counts[i] * n for i, n in x.items())
        assert cost(lengths) >= cost(free)
        if max(free.values()) <= most:
            assert cost(lengths) == cost(free)


def test_limited_lengths_are_optimal():
    counts = dict(enumerate([1, 1, 2, 3, 5, 8, 13, 21, 34, 55]))
    lengths = binary_output.code_lengths(counts, 4)
    best = None
    import itertools

    for x in itertools.combinations_with_replacement(range(1, 5), 10):
        if sum(2.0**-n for n in x) <= 1:
            cost = sum(c * n for c, n in zip(sorted(counts.values(), reverse=True), x))
            best = cost if best is None else min(best, cost)
    assert sum(counts[i] * n for i, n in lengths.items()) == best


@pytest.mark.parametrize("n,step", [(0, 4), (1, 4), (7, 4), (8, 4), (1000, 64), (65_537, 64)])
def test_blocks_round_trip(n, step):
    rng = np.random.default_rng(n)
    x = (rng.zipf(1.3, n) % 3000).astype(np.uint32)
    code = binary_output.Code(binary_output.code_lengths({int(i): int(c) for i, c in enumerate(np.bincount(x, minlength=1)) if c}, 16))
    sizes = np.array([n // 3, n - n // 3])
    keys, got_sizes, got = binary_output.read_block(code, binary_output.write_block(code, np.array([-5, 7]), sizes, x, step))
    assert keys.tolist() == [-5, 7] and got_sizes.tolist() == sizes.tolist() and (got == x).all()


def test_other_bytes_are_no_block():
    with pytest.raises(ValueError):
        binary_output.read_block(binary_output.Code({0: 1}), b"\0" * 40)


def test_files(odd, odd_rows, no_rows, spark):
    out = binary_output.read_tokens(spark, binary_output.write_tokens(odd, BYTE)).orderBy("start").collect()
    docs = [(i, np.array([*ids(BYTE, t), 0], "<u4")) for i, t in odd_rows if i is not None]
    assert [r.doc_id for r in out] == sorted(i for i, _ in docs)
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id, bytes(r.ids)) for r in out) == sorted((i, x.tobytes()) for i, x in docs)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in out)
    assert binary_output.read_tokens(spark, binary_output.write_tokens(no_rows, BYTE)).count() == 0
