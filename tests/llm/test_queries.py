"""The registered queries on a whole small table, against their SQL or a plain computation."""

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from compare import rows
from tokenizers import Tokenizer

from lattica.llm import language_id, pii, queries


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def result(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).toPandas()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    assert rows(result(spark, sf_dir, name)) == rows(duck.execute(queries.SQL[name]).df())


def encoded(docs, name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + end, "<u4") for t in docs.text]


def test_packing(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op2_best_fit_packing")
    ids = encoded(docs, "word_bpe_49k.json", [1])
    want = [(d, k, a, len(x[a : a + 4096]), zlib.crc32(x[a : a + 4096].tobytes())) for d, x in zip(docs.doc_id, ids) for k, a in enumerate(range(0, len(x), 4096))]
    assert sorted(zip(out.doc_id, out.piece, out.start, out.length, out.ids_crc32)) == sorted(want)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 4096
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 4096) + 1


def test_counts(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op3_token_counts")
    ids = encoded(docs, "byte_bpe_50k.json", [])
    want = [(d, len((t or "").encode()), len(x), len(x) > 1024) for d, t, x in zip(docs.doc_id, docs.text, ids)]
    assert sorted(zip(out.doc_id, out.n_bytes, out.n_tokens, out.over_limit)) == sorted(want)


def test_files(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op9_binary_output")
    ids = encoded(docs, "byte_bpe_50k.json", [0])
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    want = [(d, a, len(x), zlib.crc32(x.tobytes())) for d, a, x in zip(docs.doc_id, starts, ids)]
    assert sorted(zip(out.doc_id, out.start, out.n_tokens, out.ids_crc32)) == sorted(want)


def test_surrogates(spark, sf_dir, docs):
    """Entities are those of the detector, and all between them stays; equal entities have equal surrogates, unlike ones unlike."""
    out = result(spark, sf_dir, "op4_pii_surrogates").set_index("doc_id")
    made = {}
    for d, text in zip(docs.doc_id, docs.text):
        found = pii.detect(text)
        new = out.text[d]
        assert out.n_entities[d] == len(found) and list(out.kinds[d]) == [e.kind for e in found]
        at = place = 0
        for k, e in enumerate(found):
            between = text[at : e.begin]
            assert new[place : place + len(between)] == between
            place += len(between)
            following = text[e.end : found[k + 1].begin] if k + 1 < len(found) else text[e.end :]
            size = new.index(following, place) - place if following else len(new) - place
            if e.kind != "name":
                size = len(e.value) if e.kind != "ip" else size
            made.setdefault((e.kind, pii.canonical(e)), set()).add(new[place : place + size].lower() if e.kind == "email" else "".join(c for c in new[place : place + size] if c.isalnum()) if e.kind in ("phone", "card") else new[place : place + size])
            place, at = place + size, e.end
        assert new[place:] == text[at:]
    assert made and all(len({x[-10:] for x in s} if k[0] == "phone" else s) == 1 for k, s in made.items())
    flat = [(k[0], next(iter(s))) for k, s in made.items()]
    assert len(set(flat)) == len(flat)
    assert all(k[1] not in s for k, s in made.items())


def test_languages(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op5_language_id").set_index("doc_id")
    for d, text, lang in zip(docs.doc_id, docs.text, docs.lang):
        assert out.held_out[d] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert (out.lang_pred[d] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= out.score[d] <= 1
    held = docs[docs.doc_id.map(out.held_out) & docs.lang.notna()]
    assert (held.doc_id.map(out.lang_pred) == held.lang).mean() > 0.95


FOREIGN = ["これは日本語で書かれた文章です", "ข้อความนี้เขียนเป็นภาษาไทย", "Αυτή είναι μια πρόταση στα ελληνικά", "Это предложение написано на русском языке", "זה משפט שנכתב בעברית כדי לבדוק"]


def test_texts_of_unlearnt_scripts(spark, sf_dir):
    """Every text with letters has a learnt language where nothing is rejected; rejection takes these out, and clean texts stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # with enough pieces in each class of length
    model = language_id.fit(queries.training_rows(docs))
    foreign = spark.createDataFrame(list(enumerate([*FOREIGN, "123", None])), "doc_id long, text string")
    of = lambda **k: [r.lang_pred for r in language_id.identify(foreign, model, keep=["doc_id"], **k).orderBy("doc_id").collect()]
    assert set(of(rejecting=False)[:5]) <= {"en", "de", "fr", "es"} and of(rejecting=False)[5:] == ["und", "und"]
    assert of() == ["und"] * 7
    kept = language_id.identify(docs, model, keep=["doc_id"]).filter("lang_pred = 'und'").count()
    assert kept == sum(not any(c.isalpha() for c in r.text or "") for r in docs.select("text").collect())


def test_repeated_ids_teach_once(spark):
    """Rows that repeat an id are one training text, and each is judged."""
    rows = [(k % 4, "the cat sat on the mat and looked at the dog" if k % 2 else "der Hund sah die Katze auf der Matte an", "en" if k % 2 else "de") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.identify(docs, language_id.fit(docs), keep=["lang"]).collect()
    assert len(out) == 40 and all(r.lang == r.lang_pred for r in out)
