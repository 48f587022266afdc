"""Worktable job: distinct groups of a source appended to a numbered table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame

from cotejo.operators.grouped import grouped
from cotejo.sources import history

SOURCE = "worktable"  # fixed value: the source such rows name


@dataclass(frozen=True)
class WorktableRun:
    run_id: int
    rows: DataFrame
    schema_changed: bool


def run_worktable(
    source: DataFrame,
    group_by: str | Sequence[str],
    order_by: str | Sequence[str],
    *,
    target_table: str,
    created_at: datetime,
    job_id: str,
    aggs: dict[str, Column] | None = None,
) -> WorktableRun:
    """Rows are sorted within the appended files; read them back with a sort of your own."""
    spark = source.sparkSession
    groups = grouped(source, group_by, order_by, aggs)
    run_id = history.claim_run_id(spark, target_table)
    stamped = history.stamp(groups, run_id, created_at, source=SOURCE, job_id=job_id)
    changed = history.append(history.metadata_last(stamped), target_table)
    return WorktableRun(run_id, history.read_run(spark, target_table, run_id), changed)
