"""Vectorised scans of UTF-8 text in Arrow buffers: words, lines, hashes and per-document statistics.

A word is a maximal run of bytes other than space and 0x09-0x0D, which equals the pattern
``[^\\x20\\x09-\\x0D]+`` on code points, as those are single bytes in UTF-8.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keys64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd words."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


BYTE_KEYS = keys64(256, 11)
_place = keys64(4096, 29)


def place_keys(n: int) -> np.ndarray:
    """Multipliers of the first n places; grown on demand."""
    global _place
    if n > len(_place):
        _place = keys64(max(n, 2 * len(_place)), 29)
    return _place


def segment_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the non-empty byte ranges [start, end), which ascend and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    first = np.concatenate([[0], np.cumsum(length)])
    where = np.arange(first[-1], dtype=np.int64)
    place = where - np.repeat(first[:-1], length)
    where = place + np.repeat(starts, length)
    with np.errstate(over="ignore"):
        parts = BYTE_KEYS[flat[where]] * place_keys(int(length.max()))[place]
        return mix64(np.add.reduceat(parts, first[:-1]) + length.astype(np.uint64))


def words(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 offsets of each document's words among them."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~SPACE[flat]
    edge = np.zeros(len(flat) + 1, dtype=bool)
    edge[at] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]])
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of flags within each document."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def doc_of(at: np.ndarray) -> np.ndarray:
    """The document of each item, from the items' offsets."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def gram_hashes(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n consecutive items from each item, and whether all of them are in its document."""
    whole = np.zeros(len(hashes), dtype=bool)
    if len(hashes) < n:
        return np.zeros(len(hashes), np.uint64), whole
    last = np.repeat(at[1:], np.diff(at))
    whole = np.arange(len(hashes)) + n <= last
    out = np.zeros(len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        span = len(hashes) - n + 1
        for k, key in enumerate(keys64(n, 43)):
            out[:span] += hashes[k : k + span] * key
    return mix64(out), whole


def found_twice(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs at another place too."""
    if len(keys) < 2:
        return np.zeros(len(keys), dtype=bool)
    order = np.argsort(keys)
    same = np.concatenate([[False], keys[order][1:] == keys[order][:-1], [False]])
    out = np.empty(len(keys), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items lie in one of the ranges [start, start + width)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


def tied(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Keys that are equal only if the keys and their documents are."""
    with np.errstate(over="ignore"):
        return keys ^ mix64(docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))


def lines(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all \\n-split lines, and each document's offsets among them. Each document has one line at least."""
    breaks = np.flatnonzero(flat == 0x0A)
    starts = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([at[1:], breaks]), kind="stable")
    count = per_doc(flat == 0x0A, at) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(count)])


def statistics(flat: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Exact counts for each document; all zero for an empty one.

    word_chars: code points in words. n_symbols: characters of ``[#*$%&|<>]``. n_dup_lines: lines with a
    word that equal an earlier line of the text. n_repeat_words: words in three-word windows that the
    text holds twice or more, the first included.
    """
    start, end, word_at = words(flat, at)
    word_doc = doc_of(word_at)
    hashes = segment_hashes(flat, start, end)
    tri, whole = gram_hashes(hashes, word_at, 3)
    where = np.flatnonzero(whole)
    twice = where[found_twice(tied(tri[where], word_doc[where]))]
    repeated = covered(twice, 3, len(hashes))
    unique = np.zeros(len(at) - 1, np.int64)
    if len(hashes):
        keys = tied(hashes, word_doc)
        order = np.argsort(keys)
        fresh = order[np.concatenate([[True], keys[order][1:] != keys[order][:-1]])]
        unique = np.bincount(word_doc[fresh], minlength=len(at) - 1)

    low, high, line_at = lines(flat, at)
    solid = ~SPACE[flat]
    seen = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    full = np.flatnonzero(seen[high] > seen[low])
    line_doc = doc_of(line_at)[full]
    keys = tied(segment_hashes(flat, low[full], high[full]), line_doc)
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(full), dtype=bool)
    if len(full):
        again[order[1:]] = keys[order][1:] == keys[order][:-1]
    lead = (flat & 0xC0) != 0x80
    upper = (flat >= 0x41) & (flat <= 0x5A)
    return {
        "n_chars": per_doc(lead, at),
        "n_words": np.diff(word_at),
        "word_chars": per_doc(lead & solid, at),
        "n_symbols": per_doc(SYMBOL[flat], at),
        "n_dup_lines": np.bincount(line_doc[again], minlength=len(at) - 1),
        "n_repeat_words": per_doc(repeated, word_at),
        "n_lines": np.bincount(line_doc, minlength=len(at) - 1),
        "n_unique_words": unique,
        "n_upper": per_doc(upper, at),
        "n_digits": per_doc((flat >= 0x30) & (flat <= 0x39), at),
        "n_stops": per_doc((flat == 0x2E) | (flat == 0x21) | (flat == 0x3F), at),
        "n_commas": per_doc((flat == 0x2C) | (flat == 0x3B) | (flat == 0x3A), at),
        "n_pipes": per_doc(flat == 0x7C, at),
        "n_marks": per_doc((flat == 0x40) | (flat == 0x2F) | (flat == 0x5F) | (flat == 0x7B) | (flat == 0x7D) | (flat == 0x3D) | (flat == 0x5C), at),
    }


COUNTS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique_words", "n_upper", "n_digits", "n_stops", "n_commas", "n_pipes", "n_marks")


def ratios(count: dict[str, np.ndarray]) -> np.ndarray:
    """Scale-free statistics of documents, one row each, in the order of RATIOS."""
    c = {k: v.astype(np.float64) for k, v in count.items()}
    words_, chars, line = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words_,
            np.minimum(c["n_symbols"] / words_, 2),
            c["n_dup_lines"] / line,
            c["n_repeat_words"] / words_,
            np.minimum(c["n_words"] / line, 200),
            c["n_unique_words"] / words_,
            c["n_upper"] / chars,
            c["n_digits"] / chars,
            np.minimum(c["n_stops"] / words_, 2),
            np.minimum(c["n_commas"] / words_, 2),
            np.minimum(c["n_pipes"] / words_, 2),
            np.minimum(c["n_marks"] / words_, 2),
        ],
        axis=1,
    )


RATIOS = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "words_a_line", "unique_words", "upper", "digits", "stops", "commas", "pipes", "marks")
