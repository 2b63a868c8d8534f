"""What the operators share: staged tables and batch helpers."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lattica.work import shared_path

#: Bytes of text that a Python worker holds as arrays at once; a longer single text is one slice.
SLICE_BYTES = 1 << 20


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch at most, so that a batch of long texts or sets stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES, rows: int = 4096, tokenizing: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of text and at most `rows` rows; null text becomes empty.

    Workers outlive their tasks: unless the task is `tokenizing`, what an earlier one kept of tokenizers goes.
    """
    tokens = sys.modules.get("lattica.llm.tokens")
    if tokens and not tokenizing:
        tokens.release()
    for batch in slices_as_they_are(batches, column, most, rows):
        at = batch.schema.get_field_index(column)
        texts = batch.column(at)
        if texts.null_count:
            texts = pc.fill_null(texts, "")
            batch = batch.set_column(at, pa.field(column, texts.type), texts)
        yield batch


def slices_as_they_are(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of text and at most `rows` rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(ends):
            before = ends[begin - 1] if begin else 0
            end = min(begin + rows, max(begin + 1, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(begin, end - begin)
            begin = end
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system at a task's end."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def packed_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 offsets of the texts in them."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0] if len(texts) else np.zeros(1, np.int64))
