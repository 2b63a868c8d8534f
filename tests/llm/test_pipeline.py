"""The pipeline against a brute-force version of its stages, on a whole small table."""

import zlib

import corpus_pipeline
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from test_text_operators import brute_components, brute_hits, shingles, words_of
from tokenizers import Tokenizer

from lattica.llm import pii, queries
from lattica.llm.decontamination import without_words


def brute(docs, items):
    """(doc_id, text) after the first four stages."""
    rows = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    _, groups = brute_components(rows)
    least = {(i, n): c for i, n, c, _ in brute_components(rows)[0]}
    rows = [(i, t) for i, t in rows if least[i, len(shingles(t))] == i]
    assert len(rows) == groups
    out = []
    for (i, t), (n, hits, _) in zip(rows, brute_hits([t for _, t in rows], items, 10)):
        if hits > corpus_pipeline.MAX_COVERAGE * n:
            continue
        if hits:
            t = without_words(t, spans(t, items))
        out.append((i, pii.replace(t, queries.SURROGATE_KEY, {}, 6)[0]))
    return out


def spans(text, items):
    w, hit = words_of(text), set()
    for _, item in items:
        x = words_of(item)
        n = min(10, len(x))
        runs = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in runs:
                hit |= set(range(i, i + n))
    out = []
    for p in sorted(hit):
        if out and out[-1][1] == p:
            out[-1] = (out[-1][0], p + 1)
        else:
            out.append((p, p + 1))
    return out


def test_pipeline_matches_brute_force(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    # long texts make brute force slow; they are held against it by the operators' own tests
    want = []
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in brute(list(zip(docs.doc_id, docs.text)), list(zip(items.item_id.astype(str), items.text))):
        x = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want += [(i, a // 4096, a, len(x[a : a + 4096]), zlib.crc32(x[a : a + 4096].tobytes())) for a in range(0, len(x), 4096)]
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(zip(out.doc_id, out.piece, out.start, out.length, out.ids_crc32)) == sorted(want)
    assert (out.groupby("sequence_id").length.sum() <= 4096).all()


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns(spark, sf_dir, k):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)
    assert out.dtypes == docs.dtypes and 0 < out.count() <= docs.count()
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), sf_dir).count() == 0


def test_stages_take_nulls(spark, sf_dir, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf_dir)
    assert docs.count() > 0
