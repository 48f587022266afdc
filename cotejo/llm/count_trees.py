"""K-d trees over the letter counts of words, and the search for words one edit away.

Words of one length share a tree. A word is a point whose coordinates say how often each letter
occurs in it. One replaced letter takes one from a coordinate and adds one to another; one inserted
letter adds one. So the points of two near words are at most two apart, and a box is worth opening
only if no more than one letter has to be added, and no more than one taken away, to get into it.
Points that pass are compared letter by letter.

Coordinates are folded into 32 and cut off at 4, which brings points only closer together. A
coordinate is coded by four bits, one for each of 1 to 4 that it reaches, a point by 128 bits: what
has to be added are the bits of the one that the other lacks.
"""

from __future__ import annotations

import numpy as np

DIMS = 32
MOST = 4
#: Boxes or candidates compared at once.
CHUNK = 1 << 18

Codes = tuple[np.ndarray, np.ndarray]


def letters_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row per word."""
    if not words:
        return np.zeros((0, 0), "<u4")
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat.reshape(len(words), -1)


def points_of(letters: np.ndarray) -> np.ndarray:
    """Letter counts: a coordinate for each of a to z, the others share six."""
    plain = (letters >= 97) & (letters < 123)
    dims = np.where(plain, letters - 97, 26 + letters % (DIMS - 26)).astype(np.int64)
    owner = np.arange(len(letters), dtype=np.int64)[:, None] * DIMS
    counts = np.bincount((owner + dims).ravel(), minlength=len(letters) * DIMS)
    return np.minimum(counts, MOST).astype(np.int8).reshape(-1, DIMS)


def codes_of(points: np.ndarray) -> Codes:
    """The points as two arrays of 64 bits."""
    reached = points[:, :, None] >= np.arange(1, MOST + 1, dtype=np.int8)
    packed = np.packbits(reached.reshape(len(points), DIMS * MOST), axis=1)
    words = packed.view(np.uint64).reshape(len(points), 2)
    return words[:, 0].copy(), words[:, 1].copy()


def taken(codes: Codes, i: np.ndarray | slice) -> Codes:
    return codes[0][i], codes[1][i]


def missing(a: Codes, b: Codes) -> np.ndarray:
    """How much the first has to be given to reach the second in every coordinate."""
    return np.bitwise_count(b[0] & ~a[0]) + np.bitwise_count(b[1] & ~a[1])


class Splits:
    """The inner nodes of a balanced tree, split where their points part most evenly. A node of
    ``leaf_size`` points or fewer, or of equal points, keeps all of them on the left.

    ``dims`` and ``ats`` by level: points with at most ``at`` of ``dim`` go left.
    """

    def __init__(self, points: np.ndarray, depth: int, leaf_size: int = 1) -> None:
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        columns = np.arange(DIMS) * (MOST + 1)
        self.dims: list[np.ndarray] = []
        self.ats: list[np.ndarray] = []
        for level in range(depth):
            nodes = 1 << level
            cells = (node[:, None] * (DIMS * (MOST + 1)) + columns + points).ravel()
            counts = np.bincount(cells, minlength=nodes * DIMS * (MOST + 1))
            below = counts.reshape(nodes, DIMS, MOST + 1).cumsum(axis=2)[:, :, :-1]
            size = np.bincount(node, minlength=nodes)
            even = np.minimum(below, size[:, None, None] - below).reshape(nodes, -1)
            best = even.argmax(axis=1)
            closed = (size <= leaf_size) | (even[np.arange(nodes), best] == 0)
            dim = best // MOST
            at = np.where(closed, MOST, best % MOST).astype(np.int8)
            node = 2 * node + (points[rows, dim[node]] > at[node])
            self.dims.append(dim)
            self.ats.append(at)
        self.leaf = node

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for dim, at in zip(self.dims, self.ats, strict=True):
            node = 2 * node + (points[rows, dim[node]] > at[node])
        return node

    def boxes(self) -> Boxes:
        """The boxes that the splits alone leave to each node, whatever points come."""
        low = np.zeros((1, DIMS), np.int8)
        high = np.full((1, DIMS), MOST, np.int8)
        full = np.ones(1, bool)
        levels = [(codes_of(low), codes_of(high), full)]
        for dim, at in zip(self.dims, self.ats, strict=True):
            rows = 2 * np.arange(len(dim))
            low, high, full = np.repeat(low, 2, 0), np.repeat(high, 2, 0), np.repeat(full, 2)
            full[rows + 1] &= at < MOST
            high[rows, dim] = np.minimum(high[rows, dim], at)
            low[rows + 1, dim] = np.maximum(low[rows + 1, dim], np.minimum(at + 1, MOST))
            levels.append((codes_of(low), codes_of(high), full))
        return Boxes(levels)


class Boxes:
    """Least and greatest coordinates under each node of a balanced tree, and whether it has any."""

    def __init__(self, levels: list[tuple[Codes, Codes, np.ndarray]]) -> None:
        self.levels = levels

    def near(self, points: Codes, takes: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) wherever a word one edit away may be: one letter more, ``takes`` less."""
        who = np.arange(len(points[0]))
        node = np.zeros(len(who), np.int64)
        for level, (low, high, full) in enumerate(self.levels):
            if level:
                who = np.repeat(who, 2)
                node = np.repeat(2 * node, 2)
                node[1::2] += 1
            keep = np.zeros(len(who), bool)
            for start in range(0, len(who), CHUNK):
                part = slice(start, start + CHUNK)
                n, own = node[part], taken(points, who[part])
                keep[part] = full[n] & (missing(own, taken(low, n)) <= 1)
                keep[part] &= missing(taken(high, n), own) <= takes
            who, node = who[keep], node[keep]
        return who, node


class Tree:
    """Words of one length, searched for those one edit away from words as long or one shorter."""

    def __init__(self, words: list[str], leaf_size: int = 8) -> None:
        letters = letters_of(words)
        points = points_of(letters)
        depth = max(0, int(np.ceil(np.log2(max(1, len(words)) / leaf_size))))
        leaf = Splits(points, depth, leaf_size).leaf
        self.order = np.argsort(leaf, kind="stable")
        leaf, points = leaf[self.order], points[self.order]
        self.letters, self.codes = letters[self.order], codes_of(points)
        levels = []
        for level in range(depth + 1):
            edges = np.searchsorted(leaf >> (depth - level), np.arange((1 << level) + 1))
            full = edges[1:] > edges[:-1]
            low = np.zeros((1 << level, DIMS), np.int8)
            high = low.copy()
            if full.any():
                low[full] = np.minimum.reduceat(points, edges[:-1][full], axis=0)
                high[full] = np.maximum.reduceat(points, edges[:-1][full], axis=0)
            levels.append((codes_of(low), codes_of(high), full))
        self.boxes, self.edges = Boxes(levels), edges

    def near(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``letters``, place in the words given) that are one edit apart."""
        none = np.zeros(0, np.int64)
        if not len(letters) or not len(self.letters):
            return none, none
        length = letters.shape[1]
        inserted = self.letters.shape[1] - length
        if inserted not in (0, 1):
            return none, none
        points, takes = codes_of(points_of(letters)), 1 - inserted
        who, leaf = self.boxes.near(points, takes)
        first, sizes = self.edges[leaf], self.edges[leaf + 1] - self.edges[leaf]
        ends, start, out = np.cumsum(sizes), 0, [(none, none)]
        while start < len(who):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + CHUNK)))
            size = sizes[start:stop]
            w = np.repeat(who[start:stop], size)
            before = np.repeat(first[start:stop] - (np.cumsum(size) - size), size)
            at = before + np.arange(len(w))
            one, two = taken(points, w), taken(self.codes, at)
            ok = (missing(one, two) <= 1) & (missing(two, one) <= takes)
            w, at = w[ok], at[ok]
            a, b = letters[w], self.letters[at]
            if inserted:
                front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
                back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                ok = front + back >= length
            else:
                ok = (a != b).sum(axis=1) == 1
            out.append((w[ok], self.order[at[ok]]))
            start = stop
        return np.concatenate([w for w, _ in out]), np.concatenate([a for _, a in out])
