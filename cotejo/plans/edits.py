"""Edit job: a batch of manual edits of single properties, written back to the vault."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.functions.cleaning import (
    NUMERIC_TYPES,
    clean_error,
    with_clean_columns,
)
from cotejo.functions.operand import Operand, operand
from cotejo.functions.text import strip, to_text
from cotejo.operators.inventory import live_counts, recounted_inventory
from cotejo.operators.outer_join import HOT_ROWS
from cotejo.operators.scd2 import CHANGE, INSERTED, UPDATED, apply_to_touched
from cotejo.operators.skew import hot_values, is_among
from cotejo.operators.state import MANUAL_EDIT
from cotejo.sources.config import ConfigRow, load_config
from cotejo.sources.vault_store import VaultStore

ENTITY = "entidad_interna_id"


@dataclass(frozen=True)
class EditBatch:
    """The lazy tables of one batch of edits."""

    source_table: str
    inventory_before: DataFrame
    checked: DataFrame  # edits with clean values and error text
    records: DataFrame
    changes: DataFrame

    @property
    def errors(self) -> DataFrame:
        return self.checked.filter(F.col("error").isNotNull()).select(
            "source_table", ENTITY, "propiedad", "nuevo_valor", "usuario_email", "error"
        )

    def inventory(self, changes: DataFrame | None = None) -> DataFrame:
        live = live_counts(self.changes if changes is None else changes, self.source_table)
        return recounted_inventory(self.inventory_before, self.records, live)

    def summary(self, changes: DataFrame | None = None) -> DataFrame:
        changes = self.changes if changes is None else changes
        moved = changes.agg(
            F.count_if(F.col(CHANGE) == INSERTED).alias("registros_insertados"),
            F.count_if(F.col(CHANGE) == UPDATED).alias("registros_actualizados"),
        )
        edits = self.checked.agg(
            F.count_if(F.col("error").isNull()).alias("good"), F.count("error").alias("errores")
        )
        names = moved.columns + edits.columns
        totals = moved.unionByName(edits, allowMissingColumns=True).agg(
            *[F.max(name).alias(name) for name in names]
        )
        unchanged = F.col("good") - F.col("registros_insertados") - F.col("registros_actualizados")
        return totals.select(
            "registros_insertados",
            "registros_actualizados",
            unchanged.alias("registros_sin_cambio"),
            "errores",
        )


def _by_property(
    config: Sequence[ConfigRow], choose: Sequence[Column], dtype: str, otherwise: Column | None = None
) -> Column:
    """A column that depends on the edited property; one branch per configured column."""
    cases = zip(config, choose)
    start = F.when(F.lit(False), F.lit(None).cast(dtype))
    chosen = reduce(
        lambda column, case: column.when(F.col("propiedad") == case[0].columna_origen, case[1]),
        cases,
        start,
    )
    return chosen if otherwise is None else chosen.otherwise(otherwise)


def checked_edits(
    edits: DataFrame, config: Sequence[ConfigRow], inventory: DataFrame, source_table: str
) -> DataFrame:
    """Edits with key, clean value, hash, type and the reason of a rejection."""
    first: dict[str, ConfigRow] = {}
    for row in config:
        first.setdefault(row.columna_origen, row)
    rows = list(first.values())
    value = operand(edits, "nuevo_valor")
    written = to_text(value)
    if value.is_float:
        written = F.when(~F.isnan(value.column), written)
    text = Operand(written, T.StringType())
    source = inventory.filter(F.col("tabla_origen") == source_table).select(
        ENTITY, "llave_humana_completa"
    )
    kept = _by_property(rows, [F.lit(row.guardar) for row in rows], "boolean")
    email = strip(F.col("usuario_email"))
    error = F.coalesce(
        F.when(F.col("source_table") != source_table, F.lit("edit of another source table")),
        F.when(~F.coalesce(email, F.lit("")).contains("@"), F.lit("an e-mail is required")),
        F.when(kept.isNull(), F.lit("property not configured")),
        F.when(~kept, F.lit("property not kept")),
        F.when(
            F.coalesce(strip(F.col("llave_humana_completa")), F.lit("")) == "",
            F.lit("entity not in the inventory"),
        ),
        _by_property(rows, [clean_error(text, row.tipo_dato_generico) for row in rows], "string"),
    )
    named = {
        "error": error,
        "usuario_email": email,
        "raw": text.column,
        "tipo_dato_generico": _by_property(
            rows, [F.lit(row.tipo_dato_generico) for row in rows], "string"
        ),
    }
    numeric = F.lower(F.trim("tipo_dato_generico")).isin(*NUMERIC_TYPES)
    listed = edits.withColumn(ENTITY, strip(F.col(ENTITY))).join(source, ENTITY, "left")
    return with_clean_columns(listed.withColumns(named), "raw", numeric).drop("raw")


def apply_edits(
    edits: DataFrame,
    config: Sequence[ConfigRow],
    current: DataFrame,
    inventory: DataFrame,
    *,
    source_table: str,
    job_id: str,
    at: datetime,
    order_by: Sequence[str] = (),
    hot_rows: int | None = None,
) -> EditBatch:
    """Plan a batch; several edits of one property apply in ``order_by`` order, ties by hash.

    Edits of inactive entities count, as the inventory still lists them.
    """
    tie = F.xxhash64("propiedad", "nuevo_valor", "usuario_email")
    order = F.struct(*[F.col(name).alias(f"o{i}") for i, name in enumerate(order_by)], tie.alias("tie"))
    checked = checked_edits(edits.withColumn("orden", order), config, inventory, source_table)
    records = checked.filter(F.col("error").isNull()).select(
        ENTITY,
        F.col("propiedad").alias("propiedad_origen"),
        "llave_humana_completa",
        "valor_original",
        "valor_limpio",
        "firma_auditoria",
        "tipo_dato_generico",
        F.lit(source_table).alias("tabla_origen"),
        F.lit(MANUAL_EDIT).alias("origen_dato"),
        F.col("usuario_email").alias("creado_por"),
        "orden",
    )
    hot = hot_values(edits, strip(F.col(ENTITY)), hot_rows, within=edits)
    usual, hot_records = records, None
    if hot is not None:
        usual = is_among(records, F.col(ENTITY), hot, wanted=False)
        hot_records = is_among(records, F.col(ENTITY), hot, wanted=True)
    changes = apply_to_touched(
        current,
        usual,
        edits.select(strip(F.col(ENTITY)).alias(ENTITY)).distinct(),
        job_id=job_id,
        at=at,
        hot=hot,
        hot_records=hot_records,
        hot_rows=hot_rows or HOT_ROWS,
    )
    return EditBatch(source_table, inventory, checked, records, changes)


@dataclass(frozen=True)
class EditRun:
    version: int
    summary: DataFrame
    errors: DataFrame


def run_edits(
    store: VaultStore,
    edits: DataFrame,
    config: DataFrame,
    *,
    source_table: str,
    job_id: str,
    at: datetime,
    order_by: Sequence[str] = (),
) -> EditRun:
    """Apply the edits to the store. Only the buckets of the edited entities are read and written."""

    def attempt() -> EditRun:
        last = store.version()
        version = store.begin(last)
        buckets = store.touched(edits.select(strip(F.col(ENTITY)).alias(ENTITY)))
        batch = apply_edits(
            edits,
            load_config(config, source_table),
            store.current(last, buckets),
            store.inventory(last, buckets),
            source_table=source_table,
            job_id=job_id,
            at=at,
            order_by=order_by,
        )
        store.write_changes(version, batch.changes)
        inventory = batch.inventory(store.current(version, buckets))
        store.write_inventory(version, inventory, buckets)
        store.commit(version, job_id, at)
        return EditRun(version, batch.summary(store.changes(version)), batch.errors)

    with store.recorded(job_id, at):
        return store.run_again(attempt)
