"""Content-defined anchors of byte strings.

Of every window of ``length`` bytes one position is its anchor: the start of the k bytes with the
least hash. It depends on the window's bytes only, so equal windows have their anchor at the same
place, wherever they stand. Neighbouring windows mostly share an anchor; such a run of windows is
a block.
"""

from __future__ import annotations

import numpy as np

GRAM = 64
_BASE = 0x9E3779B97F4A7C15
_PLACES = 28


def gram_hashes(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hashes of all runs of k bytes (a power of two), by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    width, base = 1, _BASE
    while width < k:
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def spread(hashes: np.ndarray) -> np.ndarray:
    """63 bits for each hash, evenly spread although least hashes begin with zeros; one to one but
    for the last bit."""
    h = hashes * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of that many values."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def blocks(texts: list[bytes], length: int, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """The blocks of some texts put one after another, in order: number of the text, first and
    last window start (in all the bytes), place of the anchor, and hash of the anchor's bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 5
    low = np.uint64((1 << _PLACES) - 1)
    step, found = 1 << 24, []  # bounds the memory; the next part starts where windows end
    for start in range(0, len(data) - length + 1, step):
        piece = data[start : start + step + length - 1]
        h = gram_hashes(piece, k)
        keys = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        places = (_sliding_min(keys, length - k + 1) & low).astype(np.int64)
        found.append((places + start, h[places]))
    anchors = np.concatenate([a for a, _ in found])
    hashes = np.concatenate([h for _, h in found])
    starts = np.concatenate(
        [np.arange(e - s, e - length + 1) for s, e in zip(sizes, ends, strict=True)]
    )
    anchors, hashes = anchors[starts], hashes[starts]
    new = (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(np.append(np.ones(min(1, len(starts)), bool), new))
    last = np.append(first[1:], len(starts))[: len(first)] - 1
    text = np.searchsorted(ends, starts[first], side="right")
    return text, starts[first], starts[last], anchors[first], spread(hashes[first])
