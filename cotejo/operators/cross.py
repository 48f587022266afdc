"""Cross-check of two tables: join, label, and one comparison method per column pair."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.methods import PIPELINE, apply_method, resolve_method
from cotejo.functions.operand import operand, quoted
from cotejo.functions.text import key_text
from cotejo.operators.names import safe_part, split_list
from cotejo.operators.outer_join import full_outer, key_counts

MATCH, ONLY_A, ONLY_B = "Match", "Only A", "Only B"
STATE = "estado_cruce"


@dataclass(frozen=True)
class ColumnPair:
    """A column of each table and the method that compares them."""

    col_a: str
    col_b: str
    method: str
    options: dict[str, Any] = field(default_factory=dict)


def column_pairs(
    columns_a: str | Sequence[str], columns_b: str | Sequence[str], methods: str | Sequence[str]
) -> list[ColumnPair]:
    """Pairs from three lists of equal length, comma-separated texts or sequences."""
    lists = [split_list(columns_a), split_list(columns_b), split_list(methods)]
    if len({len(items) for items in lists}) != 1 or not lists[0]:
        raise ValueError("columns of A, columns of B and methods must be equally many")
    pairs = [ColumnPair(*items) for items in zip(*lists)]
    for pair in pairs:
        resolve_method(pair.method)
    return pairs


def raw_name(index: int, column: str, side: str) -> str:
    return f"{index}_{safe_part(column)}_{side}"


def state_label(key_a: Column, key_b: Column) -> Column:
    """Provenance by key nullness; an A row without key reads as Only B."""
    return (
        F.when(key_a.isNotNull() & key_b.isNotNull(), MATCH)
        .when(key_a.isNotNull(), ONLY_A)
        .otherwise(ONLY_B)
    )


def cross(
    a: DataFrame,
    b: DataFrame,
    key_a: str,
    key_b: str,
    pairs: Sequence[ColumnPair],
    *,
    strategy: str = "auto",
    hot_rows: int | None = None,
) -> DataFrame:
    """Full outer join on one key with text key, both keys, state and the paired columns."""
    name_a, name_b = f"{key_a}_a", f"{key_b}_b"
    left = a.select(
        F.col(quoted(key_a)).alias(name_a),
        *[F.col(quoted(p.col_a)).alias(raw_name(i, p.col_a, "a")) for i, p in enumerate(pairs)],
    )
    right = b.select(
        F.col(quoted(key_b)).alias(name_b),
        *[F.col(quoted(p.col_b)).alias(raw_name(i, p.col_b, "b")) for i, p in enumerate(pairs)],
    )
    joined = full_outer(left, right, [(name_a, name_b)], strategy=strategy, hot_rows=hot_rows)
    first, second = operand(joined, name_a), operand(joined, name_b)
    columns = [
        F.coalesce(key_text(first), key_text(second)).alias("llave_cruce"),
        first.column,
        second.column,
        state_label(first.column, second.column).alias(STATE),
    ]
    for i, pair in enumerate(pairs):
        columns.append(F.col(quoted(raw_name(i, pair.col_a, "a"))))
        columns.append(F.col(quoted(raw_name(i, pair.col_b, "b"))))
    return joined.select(*columns)


def apply_pairs(
    crossed: DataFrame, pairs: Sequence[ColumnPair], *, nulls: str = PIPELINE
) -> DataFrame:
    """Replace the raw pair columns by A, B, method label, result and, per method, a match flag."""
    results: dict[str, Column] = {}
    matches: dict[str, Column] = {}
    raw: set[str] = set()
    order: list[str] = []
    for i, pair in enumerate(pairs):
        resolved = resolve_method(pair.method, pair.options)
        names = raw_name(i, pair.col_a, "a"), raw_name(i, pair.col_b, "b")
        missing = [name for name in names if name not in crossed.columns]
        if missing:
            raise KeyError(f"columns missing in the joined table: {missing}")
        raw.update(names)
        first, second = (operand(crossed, name) for name in names)
        result, _ = apply_method(resolved, first, second, nulls)
        out = f"{i}_{resolved.suffix}"
        shown = {
            f"{i}_{safe_part(pair.col_a)}A": first.column,
            f"{i}_{safe_part(pair.col_b)}B": second.column,
            f"{i}_metodo_aplicado": F.lit(resolved.label),
            out: result,
        }
        results.update(shown)
        order.extend(shown)
        if resolved.method.match_column:
            matches[f"{i}_is_match"] = resolved.method.match(F.col(quoted(out)), resolved.options)
            order.append(f"{i}_is_match")
    base = [name for name in crossed.columns if name not in raw]
    compared = crossed.select(
        *[F.col(quoted(name)) for name in base],
        *[column.alias(name) for name, column in results.items()],
    )
    return compared.select(
        *[F.col(quoted(name)) for name in base],
        *[(matches[name] if name in matches else F.col(quoted(name))).alias(name) for name in order],
    )


def state_counts(crossed: DataFrame) -> DataFrame:
    """One row: all rows, matches, only A, only B."""
    state = F.col(STATE)
    return crossed.agg(
        F.count(F.lit(1)).alias("totalRows"),
        F.count_if(state == MATCH).alias("matches"),
        F.count_if(state == ONLY_A).alias("onlyA"),
        F.count_if(state == ONLY_B).alias("onlyB"),
    )


def key_uniqueness(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """One row: rows and distinct keys of both tables; NULL is no key."""
    known = F.col("k0").isNotNull()
    return key_counts(a, b, [(key_a, key_b)]).agg(
        F.coalesce(F.sum("rows_a"), F.lit(0)).alias("total_a"),
        F.count_if(known & (F.col("rows_a") > 0)).alias("unique_a"),
        F.coalesce(F.sum("rows_b"), F.lit(0)).alias("total_b"),
        F.count_if(known & (F.col("rows_b") > 0)).alias("unique_b"),
    )


def counted_summary(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """The summary of a cross from the rows per key on both sides: no join, no pairs.

    A row without key matches nothing and reads Only B, whichever side it is from.
    """
    known = F.col("k0").isNotNull()
    rows_a, rows_b = F.col("rows_a"), F.col("rows_b")
    pairs = rows_a.cast("decimal(19,0)") * rows_b.cast("decimal(19,0)")

    def total(rows: Column) -> Column:
        return F.coalesce(F.sum(rows), F.lit(0)).cast("long")

    counts = key_counts(a, b, [(key_a, key_b)]).agg(
        total(F.when(known, pairs)).alias("matches"),
        total(F.when(known & (rows_b == 0), rows_a)).alias("onlyA"),
        total(F.when(~known, rows_a + rows_b).when(rows_a == 0, rows_b)).alias("onlyB"),
        total(rows_a).alias("total_a"),
        total(rows_b).alias("total_b"),
        F.count_if(known & (rows_a > 0)).alias("unique_a"),
        F.count_if(known & (rows_b > 0)).alias("unique_b"),
    )
    rows = F.col("matches") + F.col("onlyA") + F.col("onlyB")
    return counts.select(
        rows.alias("totalRows"),
        "matches",
        "onlyA",
        "onlyB",
        (
            (F.col("total_a") > F.col("unique_a"))
            | (F.col("total_b") > F.col("unique_b"))
            | (rows > F.col("unique_a") + F.col("unique_b"))
        ).alias("hasDuplicates"),
    )


def cross_summary(crossed: DataFrame, uniqueness: DataFrame | None = None) -> DataFrame:
    """One row: the state counts and whether keys repeat."""
    counts = state_counts(crossed)
    if uniqueness is None:
        return counts.withColumn("hasDuplicates", F.lit(False))
    # two one-row tables side by side: stacked, then folded
    stacked = counts.unionByName(uniqueness, allowMissingColumns=True)
    names = counts.columns + uniqueness.columns
    folded = stacked.agg(*[F.max(name).alias(name) for name in names])
    return folded.select(
        *counts.columns,
        (
            (F.col("total_a") > F.col("unique_a"))
            | (F.col("total_b") > F.col("unique_b"))
            | (F.col("totalRows") > F.col("unique_a") + F.col("unique_b"))
        ).alias("hasDuplicates"),
    )
