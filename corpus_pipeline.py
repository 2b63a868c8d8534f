"""A corpus from language identification to packed sequences; every stage is an operator of lattica.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontamination, language_id, near_dedup, packing, pii, queries
from lattica.llm.shared import small_batches, stage, table

#: Documents with a larger share of benchmark words go; of others the benchmark's words go.
MAX_COVERAGE = 0.5


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns under names that no operator uses, and those names: whatever else documents carry, a stage neither meets nor changes."""
    of = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*of.values()), of


def _back(out: DataFrame, of: dict[str, str], text: str | None = None) -> DataFrame:
    """The columns as they were called; with `text`, the text and n_chars are those of that column."""
    new = {}
    if text:
        new[of["text"]] = F.col(text)
        if "n_chars" in of:
            new[of["n_chars"]] = F.char_length(text).cast(out.schema[of["n_chars"]].dataType)
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in of.values())).toDF(*of)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the languages learnt from the labelled ones; those without letters, or too far from all languages for their length, go."""
    small_batches(spark)
    model = language_id.fit(queries.training_rows(docs))
    plain, of = _plain(docs)
    out = language_id.identify(plain, model, text_col=of["text"], keep=plain.columns)
    return _back(out.filter(F.col("lang_pred") != language_id.UNKNOWN), of)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group at a similarity of 0.85 or more."""
    small_batches(spark)
    return near_dedup.deduplicate(docs, similarity=0.85, shingle=5)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the benchmark's passages out, and drop documents that are mostly those."""
    plain, of = _plain(docs)
    out = decontamination.decontaminate(
        plain, table(spark, sf_dir, "benchmark"), window=10, max_coverage=MAX_COVERAGE, id_col=of["doc_id"], text_col=of["text"], with_text=True,
        keep=[c for c in plain.columns if c != of["text"]],
    )
    return _back(out.withColumn(of["text"], F.lit(None).cast("string")), of, "clean_text")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates in the place of personal data and secrets."""
    small_batches(spark)
    plain, of = _plain(docs)
    return _back(pii.pseudonymise(plain, queries.SURROGATE_KEY, text_col=of["text"]), of, of["text"])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences of what is left: a row for each piece of a document."""
    small_batches(spark)
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1, with_ids=False)


STAGES = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("personal data", replace_personal_data),
    ("packing", pack_sequences),
]

#: Several stages have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
