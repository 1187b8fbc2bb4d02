"""Language ID: multinomial naive Bayes over hashed character n-grams.

Partitions count n-grams into a fixed matrix (languages x buckets) that is summed; its log-probabilities
are broadcast, and texts are scored in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.quality_classifier import summed
from spanloom.llm.runtime import text_chunks, texts_of
from spanloom.llm.textscan import keys64

#: Buckets of hashed n-grams; orders of the n-grams.
BUCKETS, ORDERS = 1 << 14, (1, 2, 3)
#: Languages that are learnt at most: their table is sent to all tasks, 128 KB each.
MOST_LANGUAGES = 256
#: Texts are scored in pieces of so many bytes, to bound memory.
PIECE = 1 << 18
LANG_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_KEYS = keys64(max(ORDERS), 71).astype(np.uint32)


def letters(text: pa.Array) -> np.ndarray:
    """Whether a text holds a letter of any script; false for null."""
    return pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)


def points(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of UTF-8 bytes, digits as 0 and other ASCII non-letters as space, and their offsets by document."""
    lead = (flat & 0xC0) != 0x80
    where = np.flatnonzero(lead)
    count = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])[at]
    raw = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    if len(raw) != len(where):  # bytes that aren't UTF-8: lead bytes stand for themselves
        raw = flat[where].astype(np.uint32)
    table = np.full(128, 0x20, np.uint32)
    table[0x30:0x3A] = 0x30
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    out = np.where(raw < 128, table[np.minimum(raw, 127)], raw)
    out = np.where((raw >= 0xC0) & (raw <= 0xDE) & (raw != 0xD7), raw + 32, out)
    return out, count


def grams(code: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the bucket of the n-gram at each place and whether it lies in one document and isn't all space."""
    last = np.repeat(at[1:], np.diff(at))
    place = np.arange(len(code))
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(code) < n:
                continue
            span = len(code) - n + 1
            h = np.zeros(span, np.uint32)
            solid = np.zeros(span, bool)
            for k in range(n):
                h = (h ^ code[k : k + span]) * _KEYS[k]
                h ^= h >> np.uint32(15)
                solid |= code[k : k + span] != 0x20
            yield ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int64), solid & (place[:span] + n <= last[:span])


def pieces(flat: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The documents low..high with their code points and offsets, about PIECE bytes at once or one document."""
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + PIECE, side="right")) - 1)
        code, own = points(flat[at[low] : at[high]], at[low : high + 1] - at[low])
        yield low, high, code, own
        low = high


def fit_languages(train: DataFrame, smooth: float = 0.5, most: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, their log-probabilities (bucket x language) and log-priors. ``train``: text, lang.

    Of more than ``most`` languages those with most rows are learnt (ties by name), which bounds the table.
    """
    langs = sorted(r.lang for r in train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect())
    if not langs:
        return [], np.zeros((BUCKETS, 0)), np.zeros(0)
    index, train = pa.array(langs), train.where(F.col("lang").isin(langs))

    def count(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((len(langs), BUCKETS + 1))
        for part, flat, at in text_chunks(iter([batch])):
            lang = pc.index_in(part.column("lang"), value_set=index).to_numpy(zero_copy_only=False).astype(np.int64)
            total[:, -1] += np.bincount(lang, minlength=len(langs))
            for low, high, code, own in pieces(flat, at):
                of = np.repeat(lang[low:high], np.diff(own)) * BUCKETS
                for bucket, valid in grams(code, own):
                    total[:, :-1] += np.bincount((of[: len(bucket)] + bucket)[valid], minlength=len(langs) * BUCKETS).reshape(len(langs), BUCKETS)
        return total.ravel()

    total = summed(train, count, len(langs) * (BUCKETS + 1)).reshape(len(langs), BUCKETS + 1)
    seen = total[:, :-1] + smooth
    return langs, np.log(seen / seen.sum(1, keepdims=True)).T.copy(), np.log(np.maximum(total[:, -1], 1) / total[:, -1].sum())


def predict_language(docs: DataFrame, held: int = 1, modulus: int = 3) -> DataFrame:
    """Language of each row of ``docs`` (doc_id, text, lang).

    Learnt from text and non-null lang of rows with crc32(doc_id) mod ``modulus`` != ``held``. ``score`` is the
    posterior probability of the prediction. Text that is null or has no letter, and any text when
    nothing was learnt, is ``und`` with score 0. A null doc_id is held out. Ties go to the first language
    in order; repeated rows are predicted each. Very long texts are read whole, in pieces. An empty table gives no rows; further
    columns, and columns of the result's names, are ignored. At most MOST_LANGUAGES languages are learnt.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(True))
    rows = texts_of(docs, "lang").withColumn("held_out", out)
    langs, table, prior = fit_languages(rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(table.T), prior))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, start = shared.value
        for batch, flat, at in text_chunks(batches):
            n = batch.num_rows
            total = np.tile(start, (n, 1))
            for low, high, code, own in pieces(flat, at) if langs else ():
                sums = np.zeros((len(langs), len(code) + 1))
                for bucket, valid in grams(code, own):
                    for k in range(len(langs)):
                        sums[k, 1 : len(bucket) + 1] += logs[k][bucket] * valid
                total[low:high] += np.diff(np.cumsum(sums, axis=1)[:, own], axis=1).T
            known = letters(batch.column("text")) & bool(langs)
            best = total.argmax(1) if langs else np.zeros(n, np.int64)
            share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1) if langs else np.zeros(n)
            names = [langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(known, share, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(judge, LANG_SCHEMA)
