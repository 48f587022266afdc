"""Reconcile job: compare two tables, append the outcome to a history table, summarize."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from cotejo.functions.methods import PIPELINE
from cotejo.operators.cross import (
    ColumnPair,
    apply_pairs,
    counted_summary,
    cross,
    cross_summary,
    key_uniqueness,
)
from cotejo.sources import history


def reconcile(
    a: DataFrame,
    b: DataFrame,
    key_a: str,
    key_b: str,
    pairs: Sequence[ColumnPair],
    *,
    nulls: str = PIPELINE,
    strategy: str = "auto",
    hot_rows: int | None = None,
) -> DataFrame:
    """The labelled and compared rows of both tables as one lazy plan."""
    crossed = cross(a, b, key_a, key_b, pairs, strategy=strategy, hot_rows=hot_rows)
    return apply_pairs(crossed, pairs, nulls=nulls)


def reconcile_summary(
    a: DataFrame, b: DataFrame, key_a: str, key_b: str, crossed: DataFrame | None = None
) -> DataFrame:
    """One row of counters; without ``crossed`` they follow from the rows per key."""
    if crossed is None:
        return counted_summary(a, b, key_a, key_b)
    return cross_summary(crossed, key_uniqueness(a, b, key_a, key_b))


@dataclass(frozen=True)
class ReconcileRun:
    """What a run left behind; ``run_id`` and ``rows`` are None when nothing was joined."""

    run_id: int | None
    rows: DataFrame | None
    schema_changed: bool
    summary: DataFrame


def run_reconcile(
    a: DataFrame,
    b: DataFrame,
    key_a: str,
    key_b: str,
    pairs: Sequence[ColumnPair],
    *,
    target_table: str,
    created_at: datetime,
    source: str,
    job_id: str | None = None,
    analysis_id: str | None = None,
    analysis_name: str | None = None,
    nulls: str = PIPELINE,
    strategy: str = "auto",
) -> ReconcileRun:
    """Reconcile and append. The summary needs no join, so the join runs once.

    A join without rows, which takes two empty tables, uses no run number and changes no table.
    """
    spark = a.sparkSession
    summary = reconcile_summary(a, b, key_a, key_b)
    if a.isEmpty() and b.isEmpty():
        return ReconcileRun(None, None, False, summary)
    result = reconcile(a, b, key_a, key_b, pairs, nulls=nulls, strategy=strategy)
    run_id = history.claim_run_id(spark, target_table)
    stamped = history.stamp(
        result,
        run_id,
        created_at,
        source=source,
        job_id=job_id,
        analysis_id=analysis_id,
        analysis_name=analysis_name,
    )
    changed = history.append(history.metadata_last(stamped), target_table)
    rows = history.read_run(spark, target_table, run_id)
    return ReconcileRun(run_id, rows, changed, summary)
