"""One pass over whole texts to a table of per-document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm import textscan
from spanloom.llm.runtime import text_chunks, texts_of

STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in textscan.COUNTS)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, flat, at in text_chunks(batches):
        count = textscan.statistics(flat, at)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(count[c].astype(np.int64)) for c in textscan.COUNTS]], names=["doc_id", *textscan.COUNTS])


def doc_stats(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id and the counts of ``textscan.statistics``. Null text counts as empty."""
    return texts_of(docs).mapInArrow(_scan, STATS_SCHEMA)


def ratios_of(batch: pa.RecordBatch) -> np.ndarray:
    """The RATIOS of a batch of statistics."""
    return textscan.ratios({c: batch.column(c).to_numpy(zero_copy_only=False) for c in textscan.COUNTS})
