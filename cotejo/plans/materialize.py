"""Materialize job: the current vault of a source as a wide table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.operators.pivot import wide_entities
from cotejo.sources.config import load_config
from cotejo.sources.tables import replace_table, replace_version

FIXED_COLUMNS = 5  # id, key, origin, author, updated


@dataclass(frozen=True)
class MaterializeRun:
    entidades_materializadas: int
    columnas_creadas: int


def run_materialize(
    vault: DataFrame,
    config: DataFrame,
    *,
    source_table: str,
    target_table: str,
    on_bad_number: str = "fail",
    scales: Mapping[str, int | str] | None = None,
    failures_table: str | None = None,
    job_id: str | None = None,
    versioned: bool = False,
) -> MaterializeRun:
    """Replace the target table, or with ``versioned`` point a view of that name at a new one, so
    that readers are never without it. Columns are counted from the configuration, repeats included.

    A run that fails leaves the target as it was; ``failures_table`` gets its job, target and
    reason before the error is raised.
    """
    try:
        return _materialize(
            vault,
            config,
            source_table=source_table,
            target_table=target_table,
            on_bad_number=on_bad_number,
            scales=scales,
            versioned=versioned,
        )
    except Exception as problem:
        if failures_table:
            row = vault.sparkSession.range(1, numPartitions=1).select(
                F.lit(job_id).cast("string").alias("job_id"),
                F.lit(target_table).alias("target"),
                F.lit(f"{type(problem).__name__}: {problem}"[:2000]).alias("error"),
            )
            row.write.mode("append").format("parquet").saveAsTable(failures_table)
        raise


def _materialize(
    vault: DataFrame,
    config: DataFrame,
    *,
    source_table: str,
    target_table: str,
    on_bad_number: str,
    scales: Mapping[str, int | str] | None,
    versioned: bool,
) -> MaterializeRun:
    rows = load_config(config, source_table)
    columns = sum(row.guardar for row in rows) + FIXED_COLUMNS
    wide = wide_entities(
        vault, rows, source_table=source_table, on_bad_number=on_bad_number, scales=scales
    )
    replace = replace_version if versioned else replace_table
    return MaterializeRun(replace(wide, target_table), columns)
