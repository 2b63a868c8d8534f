"""Token counts through a digest cache.

A row of the cache is (content_digest, version_digest, n_bytes, n_tokens). Texts are digested on the JVM,
reduced to their distinct digests before anything is shuffled by key, and joined to the cache; only texts that
it lacks are encoded, and their counts are appended to it. Counts then go back to every document by digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.work import shared_path

from .shared import stage, text_slices
from .tokens import Vocabulary, tokenizer

CACHE_SCHEMA = "content_digest binary, version_digest string, n_bytes long, n_tokens long"


def content_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes. The only normalisation is null to empty: any other would change counts."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, cache_path: str | None = None) -> DataFrame:
    """One row per row of docs: its id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    cache_path is a Parquet folder that outlives the call; without one, the cache begins empty in the shared
    folder. Null text counts as empty (0 bytes, 0 tokens); repeated rows and texts each get their row; a null id
    stays null; other columns of docs are not read.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(spark, path)
    version = vocabulary.digest  # another file or library version never meets old counts
    cache_path = cache_path or shared_path(spark, "token-cache")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = texts.select("id", content_digest(F.col("text")).alias("content_digest"), F.octet_length("text").cast("long").alias("n_bytes"))

    known = _cache(spark, cache_path).filter(F.col("version_digest") == version)
    misses = (
        texts.select(content_digest(F.col("text")).alias("content_digest"), "text")
        .groupBy("content_digest")
        .agg(F.first("text").alias("text"))
        .join(known.select("content_digest"), "content_digest", "left_anti")
    )

    def encode(batches):
        encoder = tokenizer(vocabulary)
        for batch in text_slices(batches, tokenizing=True):
            counts = np.diff(encoder.encode(batch.column("text"))[1])
            sizes = pc.binary_length(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("content_digest").cast(pa.binary()), pa.array([version] * len(counts), pa.string()), sizes.cast(pa.int64()), pa.array(counts, pa.int64())],
                ["content_digest", "version_digest", "n_bytes", "n_tokens"],
            )

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # runs that appended the same miss at the same time leave equal rows; staged, so that the join may split a digest of many rows
    counts = _cache(spark, cache_path).filter(F.col("version_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = stage(counts, "token-counts")
    joined = keyed.join(counts, "content_digest")
    return joined.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _cache(spark, cache_path: str) -> DataFrame:
    """The stored counts; none where nothing has been stored yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return spark.createDataFrame([], CACHE_SCHEMA)
