"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated.

The features approximate a Gaussian kernel. Each partition sums its part of the normal equations; a
fixed-size matrix reaches the driver. Scores are calibrated by isotonic regression on a fixed grid of
score bins, so that no step gathers rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.docstats import doc_stats, ratios_of
from spanloom.llm.quality_rules import labelled
from spanloom.llm.runtime import checkpointed
from spanloom.llm.textscan import COUNTS, RATIOS

N_FEATURES = 256
GRID = 2000
SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


class Fourier:
    """cos(w x + b) of standardised statistics, w and b fixed by the seed; a constant comes last."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n: int = N_FEATURES, width: float = 4.0, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.w, self.b = r.normal(0, 1 / width, (len(mean), n)), r.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.w + self.b
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))])


def summed(df: DataFrame, part, width: int) -> np.ndarray:
    """Element-wise sum over all partitions of ``part(batch)``, a vector of ``width`` doubles.

    Each partition emits one binary row; these meet in rounds of at most 64 a task, so no task holds more
    than one sum and one row at a time.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for v in batch.column("v"):
                total += np.frombuffer(v.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    parts, n = df.mapInArrow(local, "v binary"), df.rdd.getNumPartitions()
    while n > 64:
        n = -(-n // 64)
        parts = parts.repartition(n).mapInArrow(merge, "v binary")
    rows = parts.collect()
    return sum((np.frombuffer(r.v) for r in rows), np.zeros(width))


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to the values in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            w = w1 + w2
            blocks.append([(v1 * w1 + v2 * w2) / w if w else v1, w, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


class Classifier:
    """Fourier features, ridge weights and the calibrated value of each bin of the raw score."""

    def __init__(self, fourier: Fourier, weights: np.ndarray, low: float, high: float, calibrated: np.ndarray):
        self.fourier, self.weights, self.low, self.high, self.calibrated = fourier, weights, low, high, calibrated

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def cell(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(((raw - self.low) / (self.high - self.low) * GRID).astype(np.int64), 0, GRID - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated[self.cell(self.raw(x))]


def fit_classifier(train: DataFrame, ridge: float = 1e-4) -> Classifier:
    """Fitted on all rows of ``train`` (the counts and ``y``). With no rows every score is one half."""
    d, m = len(RATIOS), N_FEATURES + 1

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = ratios_of(batch)
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    total = summed(train, moments, 1 + 2 * d)
    n = total[0]
    mean = total[1 : 1 + d] / max(n, 1)
    fourier = Fourier(mean, np.sqrt(np.maximum(total[1 + d :] / max(n, 1) - mean**2, 0)))
    if not n:
        return Classifier(fourier, np.zeros(m), 0.0, 1.0, np.full(GRID, 0.5))

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y = fourier(ratios_of(batch)), batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    both = summed(train, normal, m * m + m)
    gram = both[: m * m].reshape(m, m)
    penalty = np.full(m, ridge * n)
    penalty[-1] = 1e-9 * n
    model = Classifier(fourier, np.linalg.solve(gram + np.diag(penalty), both[m * m :]), -0.5, 1.5, np.zeros(GRID))

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        cell, y = model.cell(model.raw(ratios_of(batch))), batch.column("y").to_numpy(zero_copy_only=False)
        return np.concatenate([np.bincount(cell, minlength=GRID), np.bincount(cell, y, GRID)])

    counts = summed(train, binned, 2 * GRID)
    weight, hits = counts[:GRID], counts[GRID:]
    full = np.flatnonzero(weight)
    steps = isotonic(hits[full] / weight[full], weight[full])
    # one row at the overall rate for each pooled step, so that a step of few rows claims no certainty
    pool = np.cumsum(np.concatenate([[0], np.diff(steps) != 0]))
    inside = np.bincount(pool, weight[full])
    steps = np.maximum.accumulate(((np.bincount(pool, hits[full]) + hits.sum() / n) / (inside + 1))[pool])
    model.calibrated = np.clip(np.interp(np.arange(GRID), full, steps), 0, 1)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Score of each row of ``docs``; labels of rows with crc32(doc_id) mod 5 = 0 are held out.

    Null and empty texts are scored by their statistics, which are all zero. A null doc_id counts as held
    out, and never meets a label. Repeated rows are scored each. Further columns are ignored.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    stats = checkpointed(doc_stats(docs).withColumn("held_out", out))
    train = checkpointed(labelled(stats, labels).where(~F.col("held_out")).select("y", *COUNTS))
    model = fit_classifier(train)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(ratios_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(judge, SCORE_SCHEMA)
