"""Suffix-array dedup: bytes covered by strings of a minimum length that start elsewhere too.

Anchors find the segments of text that may hold such strings; equal segments are one class from the
start. The distinct segments of an anchor meet in one block, whose suffix array and Burrows-Wheeler
transform yield the repeated strings (``bwt_repeats``). Anchors with more distinct text than a block holds
are cut finer, by what all windows of a range share, until they fit a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.anchors import segments
from spanloom.llm.bwt_repeats import repeated_starts
from spanloom.llm.jaccard_join import groups
from spanloom.llm.runtime import checkpointed, partitions, text_chunks, texts_of
from spanloom.llm.textscan import BYTE_KEYS

#: Bytes of an anchor; text that one transform indexes at once; most distinct text of one anchor in a block.
GRAM, BLOCK_BYTES, MOST_BYTES = 64, 1 << 20, (1 << 21) - (1 << 16)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``tk``, which tells rows of one doc_id apart by their text."""
    return texts_of(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", F.hash("text"))


def same_row() -> Column:
    """That rows aliased x and y are of one document and text."""
    return F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.tk") == F.col("y.tk"))


def content_key(data: bytes) -> int:
    """A signed 64-bit hash."""
    return int.from_bytes(xxhash.xxh3_64_digest(data), "big", signed=True)


def runs_of(doc: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of each run of equal neighbours, and the runs' lengths.

    Segments of one document follow each other without a gap. In periodic text (one letter, one phrase again and
    again) neighbours are equal in all they have, and one row stands for the whole run.
    """
    head = np.ones(len(doc), bool)
    for v in (doc, *same):
        head[1:] &= v[1:] == v[:-1]
    head[1:] = ~head[1:]
    first = np.flatnonzero(head)
    return first, np.diff(np.append(first, len(doc)))


def gram_of(length: int) -> int:
    """Bytes of the anchor of windows of the length."""
    return max(1, min(GRAM, length // 4))


def segment_table(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, tk, anchor key ``h``, content key ``c``, first window ``a``, number of windows ``n``, anchor's place ``o`` and repetitions ``r`` of all segments."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in text_chunks(batches):
            s = segments(BYTE_KEYS[flat], at, length, gram_of(length))
            data = memoryview(np.ascontiguousarray(flat))
            keys = np.array([content_key(data[x : x + w + length - 1]) for x, w in zip(s.flat.tolist(), s.windows.tolist(), strict=True)], np.int64)
            k, again = runs_of(s.doc, s.key, keys, s.windows, s.anchor)
            of = pa.array(s.doc[k])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(of), batch.column("tk").take(of), pa.array(s.key[k].view(np.int64)), pa.array(keys[k]), *[pa.array(v.astype(np.int32)) for v in (s.first[k], s.windows[k], s.anchor[k], again)]],
                names=["doc_id", "tk", "h", "c", "a", "n", "o", "r"],
            )

    return docs.mapInArrow(scan, "doc_id long, tk int, h long, c long, a int, n int, o int, r int")


def placed(table: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, tk and the spans of repeated windows in each of the segments of ``table``; a run of equal segments repeats throughout."""
    more = (F.col("r") - 1) * F.col("n")
    spans = table.join(runs, ["h", "c"]).select("doc_id", "tk", F.transform("runs", lambda x: F.struct((x["lo"] + F.col("a")).alias("lo"), (x["hi"] + F.col("a") + more).alias("hi"))).alias("runs"))
    return spans.groupBy("doc_id", "tk").agg(F.flatten(F.collect_list("runs")).alias("spans"))


def block_runs(parts: list[bytes], count: list[int], windows: list[int], length: int) -> list[list[tuple[int, int]]]:
    """Runs (first, last + 1) of repeated windows in each of the distinct texts; one that occurs twice repeats throughout."""
    joined = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    symbols = np.where(joined == 0xFF, 0, joined + np.uint8(1)).astype(np.uint8)
    hit, at, out = repeated_starts(symbols, length), 0, []
    for data, c, n in zip(parts, count, windows, strict=True):
        if c > 1:
            out.append([(0, n)])
        else:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[at : at + n].astype(np.int8), [0]])))
            out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
        at += len(data) + 1
    return out


RUNS = "h long, c long, runs array<struct<lo:int,hi:int>>"


def resolve_blocks(pieces: DataFrame, length: int) -> DataFrame:
    """RUNS of the distinct segments (h, c, cnt, n, data), anchors packed into blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, ["h"]):
            size = np.cumsum([len(x) for x in whole.column("data").to_pylist()])
            h = whole.column("h").to_numpy()
            heads = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h))
            low = 0
            while low < len(heads) - 1:
                base = size[heads[low] - 1] if heads[low] else 0
                high = low + 1
                while high < len(heads) - 1 and size[heads[high + 1] - 1] - base <= BLOCK_BYTES:
                    high += 1
                part = whole.slice(heads[low], heads[high] - heads[low])
                fresh: dict[tuple[int, int], tuple[bytes, int, int]] = {}
                for k, c, d, m, n in zip(*(part.column(x).to_pylist() for x in ("h", "c", "data", "cnt", "n")), strict=True):
                    fresh[k, c] = (d, m, n)
                runs = block_runs([v[0] for v in fresh.values()], [v[1] for v in fresh.values()], [v[2] for v in fresh.values()], length)
                kept = [(k, [{"lo": lo, "hi": hi} for lo, hi in r]) for k, r in zip(fresh, runs, strict=True) if r]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k, _ in kept], pa.int64()), pa.array([k[1] for k, _ in kept], pa.int64()), pa.array([r for _, r in kept], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))],
                    names=["h", "c", "runs"],
                )
                low = high

    return pieces.repartition(partitions(pieces.sparkSession), "h").sortWithinPartitions("h", "c").mapInArrow(work, RUNS)


HALF = "h long, c long, cnt long, n int, o int, data binary, blk int, j0 int, j1 int, core long, ext long"


def resolve_hot(pieces: DataFrame, length: int) -> DataFrame:
    """RUNS of distinct segments of anchors with more text than a block holds, by cutting the anchors finer until blocks do hold them.

    A window is named by its distance j before the anchor. Windows of a range of j can only be equal if the bytes that all
    of the range share ("core") are, so range and core make an anchor of their own, and a segment's windows in the range ("ext") a
    segment of it. Such anchors that fit go to the transform like all others; the rest are halved, at last to single windows.
    """
    top = 1
    while top * 2 <= length // 2:
        top *= 2

    def ranges(size: int, parents: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
                out: list[tuple] = []
                for r in batch.to_pylist():
                    lowest, highest = r["o"] - r["n"] + 1, r["o"]
                    lo, hi = (r["j0"], r["j1"]) if parents else (lowest, highest)
                    for blk in range(lo // size, hi // size + 1):
                        j0, j1 = max(lo, blk * size), min(hi, blk * size + size - 1)
                        o, d = r["o"], r["data"]
                        core = d[o - blk * size : o - (blk * size + size - 1) + length] if size > 1 else d[o - j0 : o - j0 + length]
                        ext = d[o - j1 : o - j0 + length]
                        out.append((r["h"], r["c"], r["cnt"], r["n"], o, d, blk, j0, j1, content_key(core), content_key(ext + bytes(f"{j0},{j1}", "ascii"))))
                cols = list(zip(*out, strict=True)) or [()] * 11
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in HALF.split(", ")])

        return work

    now, size, out = pieces.mapInArrow(ranges(top, False), HALF), top, []
    held = F.expr(f"substring(data, o - j1 + 1, j1 - j0 + {length})")
    while True:
        now = checkpointed(now)
        cores = now.groupBy("h", "blk", "core").agg(F.sum("cnt").alias("m"), F.sum(F.col("j1") - F.col("j0") + length).alias("bytes")).where("m > 1")
        live = now.join(cores.select("h", "blk", "core", (F.lit(size == 1) | (F.col("bytes") <= MOST_BYTES)).alias("fits")), ["h", "blk", "core"])
        small = checkpointed(live.where("fits").withColumn("h2", F.xxhash64("h", "blk", "core")))
        parts = small.groupBy("h2", "ext").agg(F.sum("cnt").alias("cnt"), F.first(held).alias("data"), F.first(F.col("j1") - F.col("j0") + 1).alias("n"))
        runs = resolve_blocks(parts.select(F.col("h2").alias("h"), F.col("ext").alias("c"), "cnt", "n", "data"), length).select(F.col("h").alias("h2"), F.col("c").alias("ext"), F.explode("runs").alias("run"))
        first = F.col("o") - F.col("j1")
        out.append(small.join(runs, ["h2", "ext"]).select("h", "c", (first + F.col("run.lo")).alias("lo"), (first + F.col("run.hi")).alias("hi")))
        big = live.where("not fits").drop("fits")
        if size == 1 or big.isEmpty():
            break
        exts = big.groupBy("h", "blk", "ext").agg(F.sum("cnt").alias("m"), F.min("c").alias("one")).where("m > 1")
        both = big.join(exts, ["h", "blk", "ext"], "left")
        out.append(both.where("m is not null").select("h", "c", first.alias("lo"), (F.col("o") - F.col("j0") + 1).alias("hi")))
        size //= 2
        # one of each group of equals goes on where others of the same core do
        rest = both.where("m is null").drop("m", "one")
        equal = both.where("c = one").withColumn("cnt", F.lit(2).cast("long")).drop("m", "one").join(rest.select("h", "blk", "core").distinct(), ["h", "blk", "core"], "left_semi")
        now = rest.unionByName(equal).select(*[f.split()[0] for f in HALF.split(", ")]).mapInArrow(ranges(size, True), HALF)
    runs = out[0]
    for more in out[1:]:
        runs = runs.unionByName(more)
    single = pieces.where("cnt > 1").select("h", "c", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    return runs.unionByName(single).groupBy("h", "c").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))


def repeated_spans(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Texts with repeats (doc_id, tk, text) and their spans (doc_id, tk, spans of repeated window starts)."""
    table = segment_table(docs, length)
    twice = checkpointed(table.groupBy("h").agg(F.sum("r").alias("m")).where("m > 1").drop("m"))
    table = checkpointed(table.join(twice, "h", "left_semi"))
    classes = table.groupBy("h", "c").agg(F.sum("r").alias("cnt"), F.min(F.struct("doc_id", "tk", "a", "n", "o")).alias("at"))
    classes = checkpointed(classes.select("h", "c", "cnt", "at.*"))
    heads = classes.groupBy("h").agg(F.count("*").alias("texts"), F.sum(F.col("n") + length).alias("bytes"))
    mixed = classes.join(heads.where("texts > 1"), "h")
    lists = mixed.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("h", "c", "cnt", "a", "n", "o", (F.col("bytes") > MOST_BYTES).alias("hot"))).alias("cut"))
    wanted = table.select("doc_id", "tk").distinct().alias("x").join(lists.alias("y"), same_row(), "left").select("x.doc_id", "x.tk", "y.cut")
    texts = docs.alias("x").join(wanted.alias("y"), same_row()).select("x.doc_id", "x.tk", "x.text", "y.cut")
    texts = checkpointed(texts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in text_chunks(batches):
            rows = []
            for text, parts in zip(batch.column("text"), batch.column("cut"), strict=True):
                raw = text.as_py().encode() if parts.is_valid else b""
                rows += [(p["h"], p["c"], p["cnt"], p["n"], p["o"], raw[p["a"] : p["a"] + p["n"] + length - 1], p["hot"]) for p in (parts.as_py() or ())]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h", "c", "cnt", "n", "o", "data", "hot"])

    pieces = texts.where("cut is not null").select("text", "cut").mapInArrow(cut, "h long, c long, cnt long, n int, o int, data binary, hot boolean")
    runs = resolve_blocks(pieces.where("not hot"), length)
    if heads.where((F.col("texts") > 1) & (F.col("bytes") > MOST_BYTES)).head(1):
        runs = runs.unionByName(resolve_hot(checkpointed(pieces.where("hot").drop("hot").dropDuplicates(["h", "c"])), length))
    pure = classes.join(heads.where("texts = 1"), "h", "left_semi").select("h", "c", F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi"))).alias("runs"))
    runs = runs.unionByName(pure)
    return texts.select("doc_id", "tk", "text"), placed(table, runs)


def cover(spans: list[dict], length: int, n: int) -> np.ndarray:
    """Which of n places windows starting in the spans cover."""
    step = np.zeros(n + 1, np.int64)
    for s in spans:
        step[s["lo"]] += 1
        step[s["hi"] + length - 1] -= 1
    return np.cumsum(step[:-1]) > 0


def stripped(docs: DataFrame, length: int, whole_characters: bool) -> DataFrame:
    """doc_id, tk, n_removed, n_spans, kept and sha of the ``keyed`` texts that lose something."""
    texts, spans = repeated_spans(docs, length)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in text_chunks(batches):
            rows = []
            for i, runs in enumerate(batch.column("spans").to_pylist()):
                data = flat[at[i] : at[i + 1]]
                gone = cover(runs, length, len(data))
                if whole_characters:
                    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                    full = np.minimum.reduceat(gone, lead[:-1]) if len(lead) > 1 else gone[:0]
                    gone = np.repeat(full, np.diff(lead))
                kept = data[~gone].tobytes()
                rows.append((int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)), kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)]], names=["doc_id", "tk", "n_removed", "n_spans", "kept", "sha"])

    gone = texts.alias("x").join(spans.alias("y"), same_row()).select("x.doc_id", "x.tk", "x.text", "y.spans").mapInArrow(strip, "doc_id long, tk int, n_removed long, n_spans long, kept binary, sha string")
    return gone.groupBy("doc_id", "tk").agg(*[F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept", "sha")])


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """Every row of ``docs`` without the bytes that strings of ``length`` bytes cover which also start elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (binary; null where nothing was removed) and
    kept_sha256. Strings never cross texts and are judged on the input; overlaps and repeats within one
    text count, so repeated rows lose all of ``length`` bytes and more. Null text counts as empty.
    """
    docs = keyed(docs)
    gone = stripped(docs, length, whole_characters=False)
    base = docs.select("doc_id", "tk", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    out = base.alias("x").join(gone.alias("y"), same_row(), "left")
    return out.select("x.doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), "kept", F.coalesce("sha", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` with repeats removed from ``text`` as ``remove_repeats`` does, but a character only if all its bytes go.

    Texts that lose nothing stay as they are, null included; other columns are kept, whatever their names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.hash(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tk"))
    gone = stripped(keyed(docs), length, whole_characters=True)
    out = rows.alias("x").join(gone.alias("y"), same_row(), "left")
    return out.select(*[F.coalesce(F.col("y.kept").cast("string"), F.col("x.row.text")).alias("text") if c == "text" else F.col(f"x.row.`{c}`") for c in docs.columns])
