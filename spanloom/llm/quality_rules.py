"""Quality rules: gradient-boosted trees over document statistics, as flat numpy node arrays.

The trees are fitted here on histograms of a bounded sample of labelled rows. Chosen statistics are
monotonic: more symbols, repeated words or repeated lines can't raise a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.docstats import doc_stats, ratios_of
from spanloom.llm.runtime import checkpointed, text_chunks, texts_of, with_columns
from spanloom.llm.textscan import COUNTS, RATIOS, ratios, statistics

#: Sign of the allowed effect on the score, by statistic.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "pipes": -1}
#: Labelled rows that the trees are fitted on at most: those of the smallest hash of doc_id.
MAX_FIT_ROWS = 20_000
RULE_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


@dataclass
class Trees:
    """Nodes of all trees end to end. A leaf is its own left and right child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 for each row of x."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for 0/1 labels under logistic loss.

    Splits are chosen on quantile bins by second-order gain. A split on a monotonic feature is allowed
    only if its children's values are in order; the middle of the two then bounds all below it.
    """
    nodes: list[list[float]] = []
    roots: list[int] = []
    positive = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(positive / (1 - positive)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros(x.shape, np.int64)
    margin = np.full(len(x), base)

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, left_levels: int, low: float, high: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        at = len(nodes)
        nodes.append([0, np.inf, at, at, rate * float(np.clip(-g / (h + ridge), low, high))])
        if not left_levels or h < 2 * least:
            return at
        best: tuple[float, int, int, float, float] | None = None
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            gl = np.cumsum(np.bincount(coded[rows, j], grad[rows], len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(coded[rows, j], hess[rows], len(cut) + 1))[:-1]
            gr, hr = g - gl, h - hl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2)
            gain[(hl < least) | (hr < least) | (signs[j] * (vr - vl) < 0)] = -np.inf
            k = int(np.argmax(gain))
            if np.isfinite(gain[k]) and (best is None or gain[k] > best[0] + 1e-12):
                best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        own = np.clip(-g / (h + ridge), low, high)
        if best is None or best[0] <= -(g * own + 0.5 * (h + ridge) * own**2) + 1e-9:
            return at
        _, j, k, vl, vr = best
        middle = (vl + vr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[j])]
        on_left = coded[rows, j] <= k
        nodes[at][:2] = [j, float(cuts[j][k])]
        nodes[at][2] = grow(rows[on_left], grad, hess, left_levels - 1, *bounds[0])
        nodes[at][3] = grow(rows[~on_left], grad, hess, left_levels - 1, *bounds[1])
        return at

    for _ in range(n_trees if len(x) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(x)), p - y, np.maximum(p * (1 - p), 1e-6), depth, -np.inf, np.inf))
        fresh = _flat(nodes, roots[-1:], depth, 0.0)
        margin += fresh.margin(x)
    return _flat(nodes, roots, depth, base)


def _flat(nodes: list[list[float]], roots: list[int], depth: int, base: float) -> Trees:
    table = np.array(nodes, dtype=np.float64).reshape(-1, 5)
    return Trees(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4], np.array(roots, dtype=np.int64), depth, base)


def labelled(stats: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """Statistics of labelled documents with ``y``. Rows without a label of 0 or 1 go; of several labels of one document the mean counts, rounded."""
    marks = with_columns(labels, {"doc_id": "bigint", column: "int"}).where(F.col(column).isin(0, 1))
    return stats.join(marks.groupBy("doc_id").agg(F.round(F.avg(column)).cast("int").alias("y")), "doc_id")


def fit_rules(stats: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> Trees:
    """Trees fitted on at most ``max_fit_rows`` labelled documents; without any label every score is one half."""
    sample = labelled(stats, labels).select("y", *COUNTS, F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(max_fit_rows).drop("h", "doc_id").toPandas()
    x = ratios({c: sample[c].to_numpy() for c in COUNTS})
    return fit_trees(x, sample["y"].to_numpy(dtype=np.float64), np.array([MONOTONE.get(r, 0) for r in RATIOS]))


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The verdict of the rules on each row of ``docs``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated three-word windows.
    ``kept``: false if base_failed, else whether the trees' score reaches ``threshold``. Null and empty
    texts have all counts 0 and fail. Rows of one doc_id are judged each by its own text; without
    labels all that the base rules pass are kept. Further columns are ignored.
    """
    stats = checkpointed(doc_stats(docs))
    trees = fit_rules(stats, labels, max_fit_rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = trees.score(ratios_of(batch))
            n, repeat = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_words", "n_repeat_words"))
            failed = (n < 50) | (100 * repeat > 50 * n)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                names=[f.split()[0] for f in RULE_SCHEMA.split(", ")],
            )

    return stats.mapInArrow(judge, RULE_SCHEMA)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``apply_rules`` keeps, with all their columns, in one pass and without a join of texts.

    Every row is judged by its own text, whatever its doc_id. The trees are those of ``apply_rules``, fitted on
    at most ``max_fit_rows`` labelled rows of the smallest hash of doc_id, of which only the ids meet the texts.
    """
    marks = with_columns(labels, {"doc_id": "bigint", "quality": "int"}).where(F.col("quality").isin(0, 1)).select("doc_id").distinct()
    ids = texts_of(docs).select("doc_id").join(marks, "doc_id").distinct().select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(max_fit_rows).select("doc_id")
    trees = fit_rules(doc_stats(texts_of(docs).join(F.broadcast(ids), "doc_id")), labels, max_fit_rows)  # max_fit_rows ids at most

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in text_chunks(batches):
            count = statistics(flat, at)
            fails = (count["n_words"] < 50) | (100 * count["n_repeat_words"] > 50 * count["n_words"])
            yield batch.filter(pa.array(~fails & (trees.score(ratios(count)) >= threshold)))

    return docs.mapInArrow(judge, docs.schema)
