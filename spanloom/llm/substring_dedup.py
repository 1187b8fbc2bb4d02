"""Substring dedup on words, by level-wise doubling.

At the first level, windows of a quarter of the length are taken where a window of the full length has
its anchor. Only those that repeat are extended to windows of twice the length on either side, and only
what repeats there goes on to the full length. Equal runs of windows are one class, so copies are
compared once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import textscan
from spanloom.llm.anchors import Segments, rolling, segments
from spanloom.llm.runtime import checkpointed, text_chunks
from spanloom.llm.suffix_dedup import content_key, cover, keyed, placed, runs_of, same_row

SEGMENT = "doc_id long, tk int, a int, n int, o int, r int, h long, left long, right long, c long"


def levels(length: int) -> tuple[int, int]:
    """Words of the windows at the first and the second level."""
    first = -(-length // 4)
    return first, min(2 * first, length)


def _units(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, own = textscan.words(flat, at)
    return textscan.segment_hashes(flat, start, end), own


def anchor_table(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, tk, first-level window hash ``h`` and first full window ``a`` of all segments."""
    first, _ = levels(length)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in text_chunks(batches):
            s = segments(*_units(flat, at), length, first)
            of = pa.array(s.doc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("tk").take(of), pa.array(s.key.view(np.int64)), pa.array(s.first.astype(np.int32))], names=["doc_id", "tk", "h", "a"])

    return docs.mapInArrow(scan, "doc_id long, tk int, h long, a int")


def chosen(s: Segments, firsts: list[list[int]]) -> np.ndarray:
    """Places of the segments whose document lists their first window."""
    want = np.array([(i << 32) + a for i, row in enumerate(firsts) for a in row or ()], np.int64)
    return np.flatnonzero(np.isin((s.doc.astype(np.int64) << 32) + s.first, want))


def extended(texts: DataFrame, length: int) -> DataFrame:
    """SEGMENT rows of the listed segments (``firsts``) of texts: second-level hashes left and right of the anchor, null
    where no full window holds them, a hash of all the segment's words, and how often it follows itself (``r``)."""
    first, second = levels(length)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in text_chunks(batches):
            units, own = _units(flat, at)
            s = segments(units, own, length, first)
            k = chosen(s, batch.column("firsts").to_pylist())
            wide = rolling(units, second)
            o, n, flat_first = s.anchor[k], s.windows[k], s.flat[k]
            place = flat_first + o
            has_left, has_right = o >= second - first, o - n + 1 <= length - second
            left = wide[np.where(has_left, place - (second - first), 0)].view(np.int64) if len(wide) else np.zeros(0, np.int64)
            right = wide[np.where(has_right, place, 0)].view(np.int64) if len(wide) else np.zeros(0, np.int64)
            keys = np.array([content_key(units[x : x + w + length - 1].tobytes()) for x, w in zip(flat_first.tolist(), n.tolist(), strict=True)], np.int64)
            # chosen segments may have gaps between them
            t, again = runs_of(s.doc[k], s.key[k], keys, n, o, s.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n)
            of = pa.array(s.doc[k][t])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(of), batch.column("tk").take(of), *[pa.array(v.astype(np.int32)) for v in (s.first[k][t], n[t], o[t], again)], pa.array(s.key[k][t].view(np.int64)), pa.array(left[t] if len(wide) else left, mask=~has_left[t]), pa.array(right[t] if len(wide) else right, mask=~has_right[t]), pa.array(keys[t])],
                names=[f.split()[0] for f in SEGMENT.split(", ")],
            )

    return texts.select("doc_id", "tk", "text", "firsts").mapInArrow(scan, SEGMENT)


def repeated_windows(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Texts with repeats (doc_id, tk, text) and their spans of window starts (doc_id, tk, spans)."""
    first, second = levels(length)
    # level one
    table = anchor_table(docs, length)
    twice = checkpointed(table.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").drop("m"))
    firsts = table.join(twice, "h", "left_semi").groupBy("doc_id", "tk").agg(F.collect_set("a").alias("firsts"))
    texts = checkpointed(docs.alias("x").join(firsts.alias("y"), same_row()).select("x.doc_id", "x.tk", "x.text", "y.firsts"))
    # level two, on the distinct segments
    table = checkpointed(extended(texts, length))
    classes = table.groupBy("h", "c").agg(F.sum("r").alias("cnt"), F.min(F.struct("doc_id", "tk", "a", "n", "o", "left", "right")).alias("at"))
    classes = checkpointed(classes.select("h", "c", "cnt", "at.*"))
    heads = classes.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").drop("texts")
    mixed = classes.join(heads, "h", "left_semi")
    sides = mixed.select("cnt", "h", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("w")), F.struct(F.lit(1).alias("side"), F.col("right").alias("w")))).alias("x")).select("cnt", "h", "x.*")
    wide = sides.where("w is not null").groupBy("h", "side", "w").agg(F.sum("cnt").alias("m")).where("m > 1").drop("m")
    left = wide.where("side = 0").select("h", F.col("w").alias("left"), F.lit(True).alias("l_ok"))
    right = wide.where("side = 1").select("h", F.col("w").alias("right"), F.lit(True).alias("r_ok"))
    mixed = mixed.join(left, ["h", "left"], "left").join(right, ["h", "right"], "left").where("l_ok or r_ok")
    # the full length, from the texts of one representative each
    lists = mixed.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("h", "c", "cnt", "a", "n", "o", F.coalesce("l_ok", F.lit(False)).alias("l_ok"), F.coalesce("r_ok", F.lit(False)).alias("r_ok"))).alias("cut"))
    held = texts.alias("x").join(lists.alias("y"), same_row()).select("x.text", "y.cut")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in text_chunks(batches):
            units, own = _units(flat, at)
            whole = rolling(units, length)
            rows: list[tuple[int, int, int]] = []
            places: list[np.ndarray] = []
            keys: list[np.ndarray] = []
            for base, parts in zip(own.tolist(), batch.column("cut").to_pylist(), strict=False):
                for p in parts:
                    w = np.arange(p["n"])
                    j = p["o"] - w
                    w = w[((j < second - first) | p["l_ok"]) & ((j > length - second) | p["r_ok"])]
                    rows.append((p["h"], p["c"], p["cnt"]))
                    places.append(w.astype(np.int32))
                    keys.append(whole[base + p["a"] + w].view(np.int64))
            at_ = pa.array(np.concatenate([[0], np.cumsum([len(w) for w in places])]).astype(np.int32))
            flat_of = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], pa.ListArray.from_arrays(at_, flat_of(places, np.int32)), pa.ListArray.from_arrays(at_, flat_of(keys, np.int64))],
                names=["h", "c", "cnt", "w", "key"],
            )

    # a row a class here, as rows of single windows would take four times the space
    windows = checkpointed(held.mapInArrow(full, "h long, c long, cnt long, w array<int>, key array<long>"))
    windows = windows.select("h", "c", "cnt", F.explode(F.arrays_zip("w", "key")).alias("x")).select("h", "c", "cnt", "x.*")
    repeats = windows.groupBy("h", "key").agg(F.sum("cnt").alias("m")).where("m > 1").drop("m")
    runs = windows.where("cnt = 1").join(repeats, ["h", "key"], "left_semi").groupBy("h", "c").agg(F.collect_list(F.struct(F.col("w").alias("lo"), (F.col("w") + 1).alias("hi"))).alias("runs"))
    pure = classes.where("cnt > 1").select("h", "c", F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi"))).alias("runs"))
    return texts.select("doc_id", "tk", "text"), placed(table, runs.unionByName(pure))


def remove_repeated_words(docs: DataFrame, length: int = 35) -> DataFrame:
    """Every row of ``docs`` without the words in windows of ``length`` words that start elsewhere too.

    Returns doc_id, n_words, n_removed, kept (words joined by one space; null where nothing was removed) and
    kept_sha256. Windows never cross texts and are judged on the input; repeats within one text count, and
    repeated rows lose all their words if they have ``length`` of them. Null text has no words.
    """
    docs = keyed(docs)
    texts, spans = repeated_windows(docs, length)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in text_chunks(batches):
            removed, kept = [], []
            for i, runs in enumerate(batch.column("spans").to_pylist()):
                parts = flat[at[i] : at[i + 1]].tobytes().split()
                gone = cover(runs, length, len(parts))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([p for p, g in zip(parts, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], names=["doc_id", "tk", "n_removed", "kept", "sha"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in text_chunks(batches):
            parts = [flat[at[i] : at[i + 1]].tobytes().split() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array([len(p) for p in parts], pa.int64()), pa.array([hashlib.sha256(b" ".join(p)).hexdigest() for p in parts])], names=["doc_id", "tk", "n_words", "whole"])

    gone = texts.alias("x").join(spans.alias("y"), same_row()).select("x.doc_id", "x.tk", "x.text", "y.spans").mapInArrow(strip, "doc_id long, tk int, n_removed long, kept string, sha string")
    gone = gone.groupBy("doc_id", "tk").agg(*[F.first(c).alias(c) for c in ("n_removed", "kept", "sha")])
    base = docs.mapInArrow(measure, "doc_id long, tk int, n_words long, whole string")
    out = base.alias("x").join(gone.alias("y"), same_row(), "left")
    return out.select("x.doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), "kept", F.coalesce("sha", "whole").alias("kept_sha256"))
