"""Jaro-Winkler similarity, which Spark has no built-in for."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the measure.
PREFIX_WEIGHT = 0.1
PREFIX_LENGTH = 4


def jaro(first: str, second: str) -> float:
    """Linear in the text lengths: every letter keeps a queue of its open positions.

    The search window only moves right, so a position left of it never opens again.
    """
    if first == second:
        return 1.0
    if not first or not second:
        return 0.0
    reach = max(0, max(len(first), len(second)) // 2 - 1)
    open_positions: dict[str, deque[int]] = defaultdict(deque)
    for position, letter in enumerate(second):
        open_positions[letter].append(position)

    matched_first: list[str] = []
    matched_second: list[int] = []
    for position, letter in enumerate(first):
        queue = open_positions.get(letter)
        while queue and queue[0] < position - reach:
            queue.popleft()
        if queue and queue[0] <= position + reach:
            matched_first.append(letter)
            matched_second.append(queue.popleft())
    matches = len(matched_first)
    if not matches:
        return 0.0
    in_order = (second[position] for position in sorted(matched_second))
    moved = sum(one != other for one, other in zip(matched_first, in_order)) / 2
    return (matches / len(first) + matches / len(second) + (matches - moved) / matches) / 3.0


def jaro_winkler_text(first: str, second: str) -> float:
    similarity = jaro(first, second)
    prefix = 0
    for one, other in zip(first[:PREFIX_LENGTH], second[:PREFIX_LENGTH]):
        if one != other:
            break
        prefix += 1
    return similarity + prefix * PREFIX_WEIGHT * (1.0 - similarity)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(first: pd.Series, second: pd.Series) -> pd.Series:
    """Each distinct pair of a batch is scored once."""
    pairs = list(zip(first, second))
    scores = {pair: jaro_winkler_text(*pair) for pair in set(pairs)}
    return pd.Series([scores[pair] for pair in pairs], dtype="float64")
