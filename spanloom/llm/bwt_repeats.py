"""Repeated fixed-length strings in a block of texts, by a Burrows-Wheeler transform.

Intervals of suffixes with a common prefix are extended backwards by one symbol at a time, breadth
first, so that the longest common prefixes of neighbouring suffixes come out in increasing order. The
search stops at the minimum length: neighbours without a value then share at least so much.
"""

from __future__ import annotations

import numpy as np


#: Blocks shorter than this sort keys that carry their place in the low bits, which is much faster.
PACKED = 1 << 21


def _ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their keys, ties by place, and the keys' ranks from 1 in that order."""
    n = len(key)
    if n < PACKED and bits <= 43:
        packed = np.sort((key << np.uint64(21)) | np.arange(n, dtype=np.uint64))
        order, key = (packed & np.uint64(PACKED - 1)).astype(np.int64), packed >> np.uint64(21)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    fresh = np.ones(n, np.int64)
    fresh[1:] = key[1:] != key[:-1]
    return order, np.cumsum(fresh)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols (0 beyond the end), ties by place; by prefix doubling."""
    n = len(symbols)
    done = min(5, depth)
    padded = np.concatenate([symbols, np.zeros(done, np.uint8)])
    key = np.zeros(n, np.uint64)
    for t in range(done):
        key = (key << np.uint64(8)) | padded[t : t + n]
    order, level = _ordered(key, 40)
    while done < depth and level[-1] < n:
        rank = np.empty(n, np.uint64)
        rank[order] = level
        step = min(done, depth - done)
        second = np.zeros(n, np.uint64)
        second[: n - step] = rank[step:]
        bits = int(level[-1]).bit_length()
        order, level = _ordered((rank << np.uint64(bits)) | second, 2 * bits)
        done += step
    return order


def repeated_starts(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Whether the ``depth`` symbols from each place occur from another place too. 0 separates texts and matches nothing."""
    if len(symbols) < 2:
        return np.zeros(len(symbols), bool)
    symbols = np.append(symbols, np.uint8(0))  # so that the first text has a separator before it
    n = len(symbols)
    order = suffix_order(symbols, depth)
    bwt = symbols[order - 1]
    counts = np.bincount(symbols, minlength=256)
    front = np.concatenate([[0], np.cumsum(counts)])
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # where the suffix one symbol longer stands
    step[by_symbol] = np.arange(n)
    before = np.full(n, -1)  # last earlier place of the same symbol
    same = bwt[by_symbol][1:] == bwt[by_symbol][:-1]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    known = np.zeros(n + 1, bool)  # neighbours i - 1, i whose common prefix has been found
    fresh = np.unique(front[:-1][counts > 0])
    known[fresh] = True
    known[n] = True
    for _ in range(1, depth):
        if not len(fresh):
            break
        found = []
        if len(fresh) * 24 > n:
            bounds = np.flatnonzero(known)
            width = bounds[np.searchsorted(bounds, fresh, side="right")] - fresh
            low = np.repeat(fresh, width)
            at = low + np.arange(len(low)) - np.repeat(np.cumsum(width) - width, width)
            target = step[at]
            hit = (before[at] < low) & ~known[target]
            found.append(target[hit])
        else:
            low = at = fresh
            steps = 0
            while len(at):
                target = step[at]
                hit = (before[at] < low) & ~known[target]
                found.append(target[hit])
                at = at + 1
                on = ~known[at]
                low, at = low[on], at[on]
                steps += 1
                if steps == 48 and len(at):
                    bounds = np.flatnonzero(known)
                    width = bounds[np.searchsorted(bounds, at, side="left")] - at
                    low = np.repeat(low, width)
                    at = np.repeat(at, width) + np.arange(len(low)) - np.repeat(np.cumsum(width) - width, width)
                    target = step[at]
                    found.append(target[(before[at] < low) & ~known[target]])
                    break
        fresh = np.concatenate(found) if found else fresh[:0]
        known[fresh] = True
    out = np.zeros(n, bool)
    out[order] = ~known[:-1] | ~known[1:]
    # a string that runs into a separator is none
    gap = np.concatenate([np.flatnonzero(symbols == 0), [n]])
    return (out & (gap[np.searchsorted(gap, np.arange(n))] - np.arange(n) >= depth))[:-1]
