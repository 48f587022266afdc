"""Outer-merge job: stack and merge sources, coalesce, derive columns, append."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.operators.merge import derive, outer_merge, stack
from cotejo.sources import history
from cotejo.sources.tables import write_csv


def merge_sources(
    sources_a: Sequence[DataFrame],
    sources_b: Sequence[DataFrame],
    keys: Sequence[str],
    rules: Iterable[tuple[str, str]] = (),
    *,
    ordered: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    merged = outer_merge(
        stack(sources_a), stack(sources_b), keys, ordered=ordered, hot_rows=hot_rows
    )
    return derive(merged, rules)


def run_outer_merge(
    sources_a: Sequence[DataFrame],
    sources_b: Sequence[DataFrame],
    keys: Sequence[str],
    rules: Iterable[tuple[str, str]] = (),
    *,
    run_id: str,
    created_at: datetime,
    target_table: str | None = None,
    csv_path: str | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Merge, stamp with the run and append to a table, or write a CSV folder."""
    merged = merge_sources(sources_a, sources_b, keys, rules, ordered=ordered)
    stamped = merged.withColumns({"run_id": F.lit(run_id), "created_at": F.lit(created_at)})
    if target_table:
        history.append(stamped, target_table)
        return merged.sparkSession.table(target_table).filter(F.col("run_id") == run_id)
    if not csv_path:
        raise ValueError("give a target table or a CSV path")
    write_csv(stamped, csv_path)
    return stamped
