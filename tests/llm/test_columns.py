"""Stages and operators meet columns that bear their own internal names."""

import corpus_pipeline
import pytest

NAMES = [
    "score", "lang_pred", "keeper_id", "keeper_text", "keeper_digest", "own_digest", "blank", "n_words", "n_hit", "spans", "item_ids", "contaminated", "clean_text", "entities",
    "text_digest", "row_id", "id", "v", "label", "bands", "bucket", "task", "place", "length", "digest", "draws", "c0", "c1", "k0", "k1", "batch", "ids", "odd name.with`signs",
]


@pytest.fixture(scope="module")
def wide(odd_rows, spark):
    rows = [(*[f"{n}-{k}" if k % 5 else None for n in NAMES], i, t, "en" if k % 2 else "de", None, None if t is None else len(t)) for k, (i, t) in enumerate(odd_rows)]
    schema = ", ".join([*(f"`{n.replace('`', '``')}` string" for n in NAMES), "doc_id long, text string, lang string, source string, n_chars long"])
    return spark.createDataFrame(rows, schema).repartition(3)


def extra(df):
    at = [df.columns.index(n) for n in [*NAMES, "doc_id", "lang", "source"]]
    return {tuple(r[k] for k in at) for r in df.collect()}


@pytest.mark.parametrize("k", range(4))
def test_stages_leave_other_columns_alone(spark, sf_dir, wide, k):
    out = corpus_pipeline.STAGES[k][1](spark, wide, sf_dir)
    assert out.dtypes == wide.dtypes and out.count() > 0
    assert extra(out) <= extra(wide)


def test_the_last_stage_reads_what_it_needs(spark, sf_dir, wide):
    assert corpus_pipeline.STAGES[4][1](spark, wide, sf_dir).count() >= wide.count()
