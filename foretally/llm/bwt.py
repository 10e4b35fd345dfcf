"""Long repeats inside one bounded bucket of bytes, by interval expansion on its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``codes`` sorted by at least the ``depth`` codes from each, by doubling."""
    n, packed = len(codes), 7
    padded = np.concatenate((codes.astype(np.int64), np.zeros(packed, dtype=np.int64)))
    key = np.zeros(n, dtype=np.int64)
    for i in range(packed):
        key = (key << 9) | padded[i:n + i]
    known = packed
    while True:
        order = np.argsort(key)
        ranked = key[order]
        fresh = np.concatenate(([1], (ranked[1:] != ranked[:-1]).astype(np.int64)))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        if known >= depth or rank[order[-1]] == n:
            return order
        key = rank * (n + 2)
        if known < n:
            key[:n - known] += rank[known:]
        known *= 2


def long_repeats(codes: np.ndarray, depth: int) -> np.ndarray:
    """Whether the ``depth`` codes from each place also start elsewhere; code 0 only divides strings.

    The interval of a string w holds the sorted suffixes that start with w. From the empty string on,
    level by level, each interval is extended backward by every byte c that its transform shows, which
    gives the interval of cw. An interval that ends where no common prefix is known yet sets it to the
    level, so common prefixes come out by increasing length. The expansion stops at ``depth``: what is
    still unknown then is at least that long.
    """
    n = len(codes)
    if n < 2:
        return np.zeros(n, dtype=bool)
    order = suffix_order(codes, depth)
    last = codes[order - 1]  # the transform
    back = np.empty(n, dtype=np.int64)
    back[np.argsort(last, kind="stable")] = np.arange(n)
    head = codes[order]
    common = np.full(n + 1, -1, dtype=np.int32)
    common[0] = common[n] = 0
    low, high = np.array([0]), np.array([n])
    for level in range(depth):
        size = high - low
        ends = np.cumsum(size)
        row = np.repeat(low - (ends - size), size) + np.arange(ends[-1])
        owner = np.repeat(np.arange(len(low)), size)
        inside = (last[row] != 0) | (level == 0)  # a string may end at a divider but not cross it
        place, owner = back[row[inside]], owner[inside]
        if not len(place):
            break
        sort = np.argsort(place)
        place, owner = place[sort], owner[sort]
        turn = (np.diff(place) != 1) | (np.diff(owner) != 0) | (np.diff(head[place]) != 0)
        low = place[np.concatenate(([True], turn))]
        high = place[np.concatenate((turn, [True]))] + 1
        fresh = common[high] < 0
        low, high = low[fresh], high[fresh]
        common[high] = level
        if not len(low):
            break
    joined = common[1:-1] < 0
    out = np.zeros(n, dtype=bool)
    out[order[1:][joined]] = True
    out[order[:-1][joined]] = True
    return out
