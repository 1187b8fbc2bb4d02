"""Anchors of long repeats: the k-gram of least hash in every window of a sequence.

Equal windows have the same anchor at the same place, wherever they stand. So windows with one anchor
form runs ("segments"), and only segments whose anchor occurs elsewhere can hold a repeated window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from spanloom.llm.textscan import keys64, mix64


def rolling(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive units from each place (64-bit units, scrambled already)."""
    if len(units) < k:
        return np.zeros(0, np.uint64)
    factor = int(keys64(1, 131)[0])
    out, size = None, 0
    power, width = units, 1
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                out = power[: len(units) - width + 1] if out is None else out[: len(units) - size - width + 1] * np.uint64(pow(factor, width, 1 << 64)) + power[size : len(units) - width + 1]
                size += width
            if size == k:
                return mix64(out)
            power = power[: len(power) - width] * np.uint64(pow(factor, width, 1 << 64)) + power[width:]
            width *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return values if done == width else np.minimum(values[: len(values) - (width - done)], values[width - done :])


@dataclass
class Segments:
    """Runs of windows with one anchor: document, first window's start (from the document's), number of windows,
    the anchor's place in the run, the anchor's hash, and the first window's start in the flat sequence."""

    doc: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    flat: np.ndarray


def segments(units: np.ndarray, at: np.ndarray, window: int, k: int) -> Segments:
    """All segments of the documents whose offsets are ``at``."""
    none = np.zeros(0, np.int64)
    if len(units) < window:
        return Segments(none, none, none, none, np.zeros(0, np.uint64), none)
    gram = rolling(units, k)
    place = np.arange(len(gram), dtype=np.uint64)
    least = sliding_min((gram & np.uint64(0xFFFFFFFF00000000)) | place, window - k + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    counts = np.maximum(np.diff(at) - window + 1, 0)
    doc = np.repeat(np.arange(len(at) - 1), counts)
    begin = np.concatenate([[0], np.cumsum(counts)])
    start = np.arange(begin[-1]) - begin[doc] + at[doc]
    own = anchor[start]
    head = np.ones(len(start), bool)
    head[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(head)
    doc, start, own = doc[cut], start[cut], own[cut]
    return Segments(doc, start - at[doc], np.diff(np.append(cut, len(head))), own - start, gram[own], start)
