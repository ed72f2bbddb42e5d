"""Shared pieces: where intermediate tables go, size-checked joins, text chunks in Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; arrays in a task are a small multiple of it.
CHUNK_BYTES = 1 << 20


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset: a temporary one on a local master (tests), an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    scratch(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; otherwise unchanged, and Spark shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def released() -> None:
    """Give free memory back to the system: Python workers are kept for later tasks, and what they hold counts against their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim keeps it
        ctypes.CDLL(None).malloc_trim(0)


def frugal(rows):
    """rows (a function for mapInArrow) that gives its memory back when its task is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            released()

    return run


def row_key(text: str | Column = "text") -> Column:
    """With a document's id this tells rows apart that share the id but not the text. A null text has the key of ''."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def wrapped(docs: DataFrame, *more: Column) -> DataFrame:
    """row (all columns of docs, whatever their names), doc_id, row_key and more; `row.*` gives docs back."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", row_key().alias("row_key"), *more)


def without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """docs without the rows that `lost` (doc_id, row_key) names; lost is broadcast if it is small, so the texts are shuffled only if it isn't."""
    lost = small(stored(lost.select(F.col("doc_id").alias("lost_id"), F.col("row_key").alias("lost_key")).distinct(), "lost"), 100_000)
    rows = wrapped(docs)
    return rows.join(lost, rows.doc_id.eqNullSafe(lost.lost_id) & (rows.row_key == lost.lost_key), "left_anti").select("row.*")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row's begin; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + at)[at:] if offsets is not None else np.zeros(n + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive whole rows of about `size` bytes, at least one: first row, end row, bytes, offsets."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values and each row's count."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i]+1, ... of counts[i] each, concatenated."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
