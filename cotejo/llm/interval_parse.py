"""Weighted interval parsing of a sequence of turns: the cheapest edits that make it a conversation.

The grammar is in Chomsky normal form. A nonterminal (p, q) derives the turns that lead from state
p to state q, the states being what stands last so far: nothing, a system, a user or an assistant
turn. Its rules are (p, q) -> (p, r) (r, q), and as terminals one turn each that is kept (K), given
the role user or assistant (R) or deleted (D). Inserting a turn (I) derives nothing from the
sequence, so insertions are no rules of the chart: each terminal's cell is closed under insertions
before and after it once and for all. A cell holds the least (cost, audit), the audit being the
initials of the edits in order.

Least audits may be put together from least audits: two audits of one cell with the same cost spell
the same turns, so that one that continued the other could do so by insertions alone and would cost
more; neither is a beginning of the other, and what follows cannot change their order.

Spans of up to ``SPAN`` turns get the whole chart, by length, over all splits. A cell of up to
``SPAN`` turns is one integer, the cost above the audit at two bits an edit, and the charts of all
spans of a length are filled at once. Longer spans are put together from neighbours of doubling
length; as each rule's both sides carry their states, any split of a span gives the same cell.
"""

from __future__ import annotations

import numpy as np

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: Turns by the initial of their role; others can only be deleted or given another role.
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER = 3
#: What is wrong with a turn: nothing, its end is missing, it has to go.
SOUND, TRUNCATED, DOOMED = range(3)
KINDS = 4 * 3
LETTERS = "DIKR"
#: Turns of a whole chart; with insertions they have 27 edits at most.
SPAN = 12
SHIFT = 2 * 27
NONE = np.int64(1) << 61

Cell = tuple[int, str]
Cells = list[list[Cell | None]]


def moves(initial: int) -> list[tuple[int, int]]:
    """From and to of a turn that is left with this role."""
    return {
        0: [(START, SYSTEM)],
        1: [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)],
        2: [(USER, ASSISTANT)],
    }.get(initial, [])


def joined(left: Cells, right: Cells) -> Cells:
    """The cells of a span from those of its two parts."""
    out: Cells = [[None] * STATES for _ in range(STATES)]
    for p in range(STATES):
        for q in range(STATES):
            found = None
            for r in range(STATES):
                a, b = left[p][r], right[r][q]
                if a is None or b is None:
                    continue
                cost = a[0] + b[0]
                if found is None or cost <= found[0]:
                    cell = (cost, a[1] + b[1])
                    found = cell if found is None else min(found, cell)
            out[p][q] = found
    return out


def _insertions() -> Cells:
    """What it takes to get from state to state by inserting alone."""
    out: Cells = [[(0, "") if p == q else None for q in range(STATES)] for p in range(STATES)]
    step: Cells = [[None] * STATES for _ in range(STATES)]
    for initial in (1, 2):
        for p, q in moves(initial):
            step[p][q] = (2, "I")
    for _ in range(STATES):
        more = joined(out, step)
        for p in range(STATES):
            for q in range(STATES):
                found = [c for c in (out[p][q], more[p][q]) if c is not None]
                out[p][q] = min(found, default=None)
    return out


def terminal(initial: int, fault: int) -> Cells:
    """The cells of one turn, with insertions around it."""
    own: Cells = [[None] * STATES for _ in range(STATES)]

    def offer(p: int, q: int, cell: Cell) -> None:
        own[p][q] = min(x for x in (own[p][q], cell) if x is not None)

    for p in range(STATES):
        offer(p, p, (3, "D"))
    if fault != DOOMED:
        extra = int(fault == TRUNCATED)
        for p, q in moves(initial):
            offer(p, q, (extra, "K"))
        for role in (1, 2):
            for p, q in moves(role):
                offer(p, q, (2 + extra, "R"))
    around = _insertions()
    return joined(joined(around, own), around)


def _packed(cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    values = np.full((STATES, STATES), NONE, np.int64)
    sizes = np.zeros((STATES, STATES), np.int64)
    for p in range(STATES):
        for q in range(STATES):
            if cells[p][q] is not None:
                cost, audit = cells[p][q]
                code = sum(LETTERS.index(x) << (SHIFT - 2 - 2 * i) for i, x in enumerate(audit))
                values[p, q], sizes[p, q] = (cost << SHIFT) | code, len(audit)
    return values, sizes


def _unpacked(value: int, size: int) -> Cell | None:
    if value >= NONE:
        return None
    audit = "".join(LETTERS[(value >> (SHIFT - 2 - 2 * i)) & 3] for i in range(size))
    return value >> SHIFT, audit


TERMINALS = [terminal(kind // 3, kind % 3) for kind in range(KINDS)]
_VALUES, _SIZES = (np.stack(x) for x in zip(*map(_packed, TERMINALS), strict=True))
_LOW = (np.int64(1) << SHIFT) - 1


def charts(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of whole spans of one length: a row of ``kinds`` (3 * initial + fault) per span.

    The chart is filled by length of the span, each span over all its splits.
    """
    n = kinds.shape[1]
    values, sizes = [None, _VALUES[kinds]], [None, _SIZES[kinds]]
    for length in range(2, n + 1):
        starts = n - length + 1
        best = np.full((len(kinds), starts, STATES, STATES), NONE, np.int64)
        size = np.zeros_like(best)
        for cut in range(1, length):
            a, m = values[cut][:, :starts], sizes[cut][:, :starts]
            b = values[length - cut][:, cut : cut + starts]
            o = sizes[length - cut][:, cut : cut + starts]
            for r in range(STATES):
                x, y = a[..., :, r, None], b[..., None, r, :]
                k = m[..., :, r, None]
                both = x + (y & ~_LOW) + ((y & _LOW) >> (2 * k))
                better = both < best
                best = np.where(better, both, best)
                size = np.where(better, k + o[..., None, r, :], size)
        values.append(np.minimum(best, NONE))
        sizes.append(size)
    return values[n][:, 0], sizes[n][:, 0]


def span_cells(sequences: list[np.ndarray]) -> list[Cells]:
    """The cells of each sequence of kinds, none of them empty."""
    blocks: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for who, kinds in enumerate(sequences):
        for at in range(0, len(kinds), SPAN):
            block = kinds[at : at + SPAN]
            blocks.setdefault(len(block), []).append((who, at, block))
    parts: list[dict[int, Cells]] = [{} for _ in sequences]
    for found in blocks.values():
        values, sizes = charts(np.stack([kinds for _, _, kinds in found]))
        for (who, at, _), value, size in zip(found, values.tolist(), sizes.tolist(), strict=True):
            parts[who][at] = [
                [_unpacked(v, s) for v, s in zip(vs, ss, strict=True)]
                for vs, ss in zip(value, size, strict=True)
            ]
    return [combined([own[at] for at in sorted(own)]) for own in parts]


def combined(spans: list[Cells]) -> Cells:
    """Neighbouring spans put together, two by two, until one is left."""
    while len(spans) > 1:
        pairs = [joined(spans[i], spans[i + 1]) for i in range(0, len(spans) - 1, 2)]
        spans = pairs + spans[len(spans) - len(spans) % 2 :]
    return spans[0]


def conclusion(cells: Cells) -> Cell:
    """The whole sequence: nothing at all, or something that ends with an assistant turn."""
    return min(c for c in (cells[START][START], cells[START][ASSISTANT]) if c is not None)


class Repair:
    """Applies an audit to turns in order, in as many calls as one likes."""

    def __init__(self, state: int = START) -> None:
        self.state = state

    def _next(self) -> tuple[int, str]:
        return (USER, "user") if self.state != USER else (ASSISTANT, "assistant")

    def lines(self, audit: str, turns: list[tuple[str, str]]) -> list[str]:
        out, at = [], 0
        for edit in audit:
            if edit == "I":
                self.state, role = self._next()
                out.append(f"{role}:")
                continue
            role, text = turns[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                self.state, role = self._next()
            else:
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            out.append(f"{role}:{text}")
        return out
