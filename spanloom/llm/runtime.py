"""Shared plumbing: lineage cuts in the shared folder, and bounded Arrow batches of text."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass handles at once; a single longer text is handled alone.
CHUNK_BYTES = 1 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the cluster's shared checkpoint folder.

    The folder is the one ``spark.checkpoint.dir`` names; where that is unset (local tests), a
    temporary one is used. Files go when nothing refers to the frame and the cleaner is on.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spanloom-checkpoint-"))
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_columns(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """The required columns cast to their types, others left out; a missing one is an error."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in required.items()])


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` and the named further columns of a documents table."""
    return with_columns(docs, {"doc_id": "bigint", "text": "string"} | {c: "string" for c in more})


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text (or one row), with their buffers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, at = buffers(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, side="right")) - 1)
            yield batch.slice(low, high - low), flat[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high
