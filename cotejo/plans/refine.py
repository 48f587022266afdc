"""Refine job: wide source rows into the versioned property vault and the entity inventory."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions.identity import DEFAULT_SEPARATOR
from cotejo.functions.operand import quoted
from cotejo.operators.acceptance import accepted, acceptance_flag
from cotejo.operators.inventory import live_counts, missing_entities, updated_inventory
from cotejo.operators.outer_join import HOT_ROWS
from cotejo.operators.records import (
    ENTITY,
    ERROR,
    KEY,
    counted_entities,
    has_key,
    identified,
    property_records,
    stored_ids,
)
from cotejo.operators.scd2 import (
    CHANGE,
    DROPPED,
    INSERTED,
    UPDATED,
    apply_changes,
)
from cotejo.operators.skew import hot_values, is_among
from cotejo.operators.state import ACTIVE, empty
from cotejo.sources.config import ConfigRow, kept_properties, load_config
from cotejo.sources.vault_store import VaultStore


ACCEPTED = "__accepted"  # added to source rows

COUNTERS = (
    "filas_procesadas",
    "filas_omitidas",
    "registros_insertados",
    "registros_actualizados",
    "registros_sin_cambio",
    "registros_eliminados",
    "entidades_inactivadas",
    "recien_inactivadas",
    "errores",
)


@dataclass(frozen=True)
class Refinement:
    """The lazy tables of one run over one source."""

    source_table: str
    job_id: str
    at: datetime
    inventory_before: DataFrame
    source: DataFrame
    rows: DataFrame  # accepted rows with key, entity, order and error
    counted: DataFrame  # entities, errors and rejected rows of the source, counted in one pass
    missing: DataFrame
    changes: DataFrame  # vault rows of the run, labelled
    properties: int

    @property
    def seen(self) -> DataFrame:
        return _seen(self.counted)

    @property
    def vault(self) -> DataFrame:
        """The vault rows the run leaves, without those closed earlier."""
        return self.changes.drop(CHANGE)

    @property
    def errors(self) -> DataFrame:
        """The rows that failed, as they came, with key and reason."""
        return self.rows.filter(F.col(ERROR).isNotNull()).select(
            F.col(KEY).alias("llave_humana_completa"),
            F.col(ERROR).alias("error"),
            *[quoted(name) for name in self.source.columns],
        )

    def inventory(self, changes: DataFrame | None = None) -> DataFrame:
        """``changes`` may be the written rows of the run, so that they are not computed again."""
        live = live_counts(self.changes if changes is None else changes, self.source_table)
        return updated_inventory(
            self.inventory_before,
            self.seen,
            live,
            source_table=self.source_table,
            job_id=self.job_id,
            at=self.at,
        )

    def summary(self, changes: DataFrame | None = None) -> DataFrame:
        """One row of counters. Records that left no version are the unchanged ones."""
        changes = self.changes if changes is None else changes
        kept = F.col("accepted")
        processed = self.counted.agg(
            *[
                F.coalesce(F.sum(F.when(which, F.col(name))), F.lit(0)).cast("long").alias(total)
                for name, which, total in (
                    ("rows", kept, "filas_procesadas"),
                    ("errors", kept, "errores"),
                    ("rows", ~kept, "filas_omitidas"),
                )
            ]
        )
        moved = changes.agg(
            F.count_if(F.col(CHANGE) == INSERTED).alias("registros_insertados"),
            F.count_if(F.col(CHANGE) == UPDATED).alias("registros_actualizados"),
            F.count_if(F.col(CHANGE) == DROPPED).alias("registros_eliminados"),
        )
        inactivated = self.missing.agg(
            F.count(F.lit(1)).alias("entidades_inactivadas"),
            F.count_if(F.col("estado_entidad") == ACTIVE).alias("recien_inactivadas"),
        )
        parts = [processed, moved, inactivated]
        stacked = parts[0]
        for part in parts[1:]:
            stacked = stacked.unionByName(part, allowMissingColumns=True)
        names = [name for part in parts for name in part.columns]
        totals = stacked.agg(*[F.max(name).alias(name) for name in names])
        records = (F.col("filas_procesadas") - F.col("errores")) * self.properties
        unchanged = records - F.col("registros_insertados") - F.col("registros_actualizados")
        return totals.withColumn("registros_sin_cambio", unchanged).select(*COUNTERS)


def _seen(counted: DataFrame) -> DataFrame:
    return counted.filter(F.col("entidad_interna_id").isNotNull()).select(
        "entidad_interna_id", "llave_humana_completa", "faultless"
    )


def refine(
    source: DataFrame,
    config: Sequence[ConfigRow],
    current: DataFrame,
    inventory: DataFrame,
    *,
    source_table: str,
    job_id: str,
    at: datetime,
    separator: str = DEFAULT_SEPARATOR,
    order_by: Sequence[str] = (),
    hot_rows: int | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> Refinement:
    """Plan a run; ``current`` holds the current vault rows of all sources.

    The source is read once for the counts of its entities and once for the records. ``keep`` may
    write the counts, which three later steps read, and give them back as written.
    ``order_by`` names the source columns that order several rows of one entity. ``hot_rows``
    forces the count of rows per entity and sets from which count an entity is hot.
    """
    if not separator:
        raise ValueError("the key separator cannot be empty")
    known = stored_ids(inventory, source_table)
    rows = identified(accepted(source), config, known, separator=separator, order_by=order_by)
    tagged = identified(
        acceptance_flag(source, ACCEPTED), config, known, separator=separator, order_by=order_by
    )
    counted = keep(counted_entities(tagged, ACCEPTED, shared_ids=known is not None))
    missing = missing_entities(
        inventory, _seen(counted), source_table=source_table, job_id=job_id
    )
    first = inventory.filter(F.col("tabla_origen") == source_table).isEmpty()
    if first:  # nothing of this source can be missing, so nothing need be looked for
        missing = empty(source.sparkSession, missing.schema)
    present = [row for row in kept_properties(config) if row.columna_origen in source.columns]
    alike = F.col(KEY if known is None else ENTITY)
    hot = hot_values(rows.filter(has_key()), F.col(ENTITY), hot_rows, within=source, alike=alike)
    usual, hot_records = rows, None
    if hot is not None:
        entity = F.col(ENTITY)
        usual = is_among(rows, entity, hot, wanted=False)
        hot_records = property_records(
            is_among(rows, entity, hot, wanted=True),
            config,
            source_table=source_table,
            placed=False,
        )
        hot = hot.withColumn("rows", F.col("rows") * len(present))
    changes = apply_changes(
        current,
        property_records(usual, config, source_table=source_table),
        job_id=job_id,
        at=at,
        removed=None if first else missing,
        source_table=source_table,
        hot=hot,
        hot_records=hot_records,
        hot_rows=hot_rows or HOT_ROWS,
    )
    return Refinement(
        source_table, job_id, at, inventory, source, rows, counted, missing, changes, len(present)
    )


@dataclass(frozen=True)
class RefineRun:
    """``version`` is None for a run that failed as a whole."""

    version: int | None
    summary: DataFrame
    errors: DataFrame


def failed_run(spark: SparkSession, problem: Exception) -> RefineRun:
    """The summary of a run that came to nothing: its one error is what ended it."""
    row = spark.range(1, numPartitions=1)
    counts = [F.lit(int(name == "errores")).cast("long").alias(name) for name in COUNTERS]
    reason = F.lit(f"{type(problem).__name__}: {problem}"[:2000]).alias("error")
    nothing = F.lit(None).cast("string").alias("llave_humana_completa")
    return RefineRun(None, row.select(*counts), row.select(nothing, reason))


def run_refine(
    store: VaultStore,
    source: DataFrame,
    config: DataFrame,
    *,
    source_table: str,
    job_id: str,
    at: datetime,
    separator: str = DEFAULT_SEPARATOR,
    order_by: Sequence[str] = (),
    on_failure: str = "raise",
) -> RefineRun:
    """Refine into the store: the counts and the changes are written once, the rest follows.

    A run that fails is listed in the store's failures and raises, or with
    ``on_failure="summary"`` gives a summary with the failure as its error. One that another run
    was quicker than is planned again on what that one left.
    """
    if on_failure not in ("raise", "summary"):
        raise ValueError("on_failure must be 'raise' or 'summary'")

    def attempt() -> RefineRun:
        last = store.version()
        version = store.begin(last)
        run = refine(
            source,
            load_config(config, source_table),
            store.current(last),
            store.inventory(last),
            source_table=source_table,
            job_id=job_id,
            at=at,
            separator=separator,
            order_by=order_by,
            keep=lambda counted: store.keep_counted(version, counted),
        )
        store.write_changes(version, run.changes)
        store.write_inventory(version, run.inventory(store.current(version)))
        store.commit(version, job_id, at)
        return RefineRun(version, run.summary(store.changes(version)), run.errors)

    try:
        with store.recorded(job_id, at):
            return store.run_again(attempt)
    except Exception as problem:
        if on_failure == "raise":
            raise
        return failed_run(source.sparkSession, problem)
