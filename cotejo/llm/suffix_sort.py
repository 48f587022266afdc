"""Two-stage suffix sorting of many short byte strings.

Only suffixes smaller than their successors are compared directly. All others are induced: going
through the suffixes in order, bucket by bucket of their first bytes, the one that begins a byte
earlier is next in the bucket of that byte. Suffixes are ordered by their first ``length`` bytes
at least, so those that share them end up side by side.
"""

from __future__ import annotations

import numpy as np


def _falling(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Marks suffixes larger than their successors, as far as ``length`` bytes show."""
    places = np.arange(len(data))
    changes = np.flatnonzero(data[1:] != data[:-1])
    at = np.searchsorted(changes, places)
    following = np.append(changes + 1, len(data))[at]  # the first byte that differs
    own_end = ends[np.searchsorted(ends, places, side="right")]
    seen = following < np.minimum(places + length, own_end)
    return seen & (data > data[np.minimum(following, len(data) - 1)])


def sorted_starts(
    data: bytes, begins: np.ndarray, runs: np.ndarray, ends: np.ndarray, length: int
) -> list[int]:
    """The first ``runs`` suffixes of each string in order. A string is data[begin:end], strings
    follow one another, and the last of their runs has ``length`` bytes at least."""
    numbers = np.frombuffer(data, np.uint8)
    falling = _falling(numbers, ends, length)
    # a falling suffix needs its successors up to one that does not fall
    rising = np.flatnonzero(~falling)
    last = rising[np.searchsorted(rising, begins + runs - 1)]
    needed = np.zeros(len(data) + 1, np.int64)
    np.add.at(needed, begins, 1)
    np.add.at(needed, last + 1, -1)
    needed = np.cumsum(needed[:-1]) > 0
    direct = np.flatnonzero(needed & ~falling)
    stops = np.minimum(direct + length, ends[np.searchsorted(ends, direct, side="right")])
    keys = {p: data[p:e] for p, e in zip(direct.tolist(), stops.tolist(), strict=True)}
    buckets: list[list[int]] = [[] for _ in range(256)]
    for p in sorted(keys, key=keys.__getitem__):
        buckets[data[p]].append(p)
    induced: list[list[int]] = [[] for _ in range(256)]
    wanted = bytes(needed & falling) + b"\0"  # at -1 too: nothing before the first
    order: list[int] = []
    for byte in range(256):
        for part in (induced[byte], buckets[byte]):
            for p in part:  # grows while it is gone through
                if wanted[p - 1]:
                    induced[data[p - 1]].append(p - 1)
            order += part
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, begins, 1)
    np.add.at(inside, begins + runs, -1)
    starts = bytes(np.cumsum(inside[:-1]) > 0)
    return [p for p in order if starts[p]]


def common_prefix(a: bytes, b: bytes) -> int:
    """Number of first bytes that two strings share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)
    return int(np.argmax(x))


def adjacent_prefixes(data: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in order, the number of first bytes, ``most`` at most, that it shares with the
    one before it; 0 for the first.

    Hashes of prefixes are compared by bisection for all neighbours at once. They may find too long
    a prefix, never too short a one; what they find as whole is compared byte by byte.
    """
    numbers = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    base, n = np.uint64(0x9E3779B97F4A7C15), len(numbers)
    powers = np.cumprod(np.append(np.uint64(1), np.full(most, base)), dtype=np.uint64)
    levels = [numbers]  # hashes of runs of 1, 2, 4, ... bytes
    while 2 << (len(levels) - 1) <= most:
        width = 1 << (len(levels) - 1)
        h = levels[-1]
        levels.append(h[:-width] * powers[width] + h[width:] if len(h) > width else h[:0])
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    shared = np.zeros(len(b), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        width, h = 1 << level, levels[level]
        for _ in range(2 if level == len(levels) - 1 else 1):
            x, y = a + shared, b + shared
            fits = (shared + width <= most) & (np.maximum(x, y) + width <= n)
            fits[fits] = h[x[fits]] == h[y[fits]]
            shared[fits] += width
    for i in np.flatnonzero(shared == most).tolist():
        p, q = int(a[i]), int(b[i])
        if data[p : p + most] != data[q : q + most]:
            shared[i] = common_prefix(data[p : p + most], data[q : q + most])
    return np.append(np.zeros(min(1, len(order)), np.int64), shared)


def classes(data: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order, the number of its class: neighbours whose common prefix has
    ``length`` bytes share one."""
    return np.cumsum(adjacent_prefixes(data, order, length) < length) - 1
