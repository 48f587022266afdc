"""Inventory of entities: who was seen, who went missing, how many live properties each has."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.operators.state import ACTIVE, CURRENT, INACTIVE, INVENTORY_SCHEMA

ENTITY = "entidad_interna_id"


def live_counts(vault: DataFrame, source_table: str) -> DataFrame:
    """Current rows of a source per entity."""
    return (
        vault.filter((F.col("estado") == CURRENT) & (F.col("tabla_origen") == source_table))
        .groupBy(ENTITY)
        .agg(F.count(F.lit(1)).cast("int").alias("live"))
    )


def _of_other_job(job_id: str) -> Column:
    return ~F.col("job_id").eqNullSafe(F.lit(job_id))


def missing_entities(
    inventory: DataFrame, seen: DataFrame, *, source_table: str, job_id: str
) -> DataFrame:
    """Entities of the source that this run did not see; those already inactive count again."""
    return (
        inventory.filter((F.col("tabla_origen") == source_table) & _of_other_job(job_id))
        .join(seen.select(ENTITY), ENTITY, "left_anti")
        .select(ENTITY, "estado_entidad")
    )


def updated_inventory(
    inventory: DataFrame,
    seen: DataFrame,
    live: DataFrame,
    *,
    source_table: str,
    job_id: str,
    at: datetime,
) -> DataFrame:
    """The inventory after a run: seen entities active, missing ones inactive, others as before.

    The three inputs hold one row per entity. The live counts are placed by entity already; the
    others are placed alike, so what is stacked is folded without another shuffle.
    """
    stacked = (
        inventory.select(ENTITY, F.struct(*INVENTORY_SCHEMA.names[1:]).alias("old"))
        .repartition(ENTITY)
        .unionByName(
            seen.select(
                ENTITY, F.col("llave_humana_completa").alias("key"), "faultless"
            ).repartition(ENTITY),
            allowMissingColumns=True,
        )
        .unionByName(live, allowMissingColumns=True)
    )
    rows = (
        stacked.groupBy(ENTITY)
        .agg(
            F.max("old").alias("old"),
            F.max("key").alias("key"),
            F.max("faultless").alias("faultless"),
            F.max("live").alias("live"),
        )
        .filter(F.col("old").isNotNull() | F.col("key").isNotNull())
    )
    old = {name: F.col(f"old.{name}") for name in INVENTORY_SCHEMA.names[1:]}
    seen_now = F.col("key").isNotNull()
    own = old["tabla_origen"] == source_table
    same_job = old["job_id"].eqNullSafe(F.lit(job_id))
    missing = ~seen_now & own & ~same_job
    recounted = ~seen_now & own & same_job & F.col("live").isNotNull()
    count_seen = F.coalesce(
        F.col("live"),
        F.when(F.col("faultless"), F.lit(0)),
        old["total_propiedades_activas"],
        F.lit(0),
    )
    return rows.select(
        ENTITY,
        F.when(seen_now, F.col("key"))
        .otherwise(old["llave_humana_completa"])
        .alias("llave_humana_completa"),
        F.when(seen_now, F.lit(source_table)).otherwise(old["tabla_origen"]).alias("tabla_origen"),
        F.when(seen_now, F.lit(ACTIVE))
        .when(missing, F.lit(INACTIVE))
        .otherwise(old["estado_entidad"])
        .alias("estado_entidad"),
        F.when(seen_now, count_seen)
        .when(missing, F.lit(0))
        .when(recounted, F.col("live"))
        .otherwise(old["total_propiedades_activas"])
        .cast("int")
        .alias("total_propiedades_activas"),
        F.when(seen_now | missing | recounted, F.lit(at))
        .otherwise(old["actualizado_en"])
        .alias("actualizado_en"),
        F.when(seen_now, F.lit(job_id)).otherwise(old["job_id"]).alias("job_id"),
    )


def recounted_inventory(
    inventory: DataFrame, edited: DataFrame, live: DataFrame
) -> DataFrame:
    """Live counts renewed for the edited entities only; nothing else of them changes."""
    touched = edited.select(ENTITY).distinct().withColumn("touched", F.lit(True))
    counts = touched.join(live, ENTITY, "left")
    total = F.when(F.col("touched"), F.coalesce("live", F.lit(0))).otherwise(
        F.col("total_propiedades_activas")
    )
    return (
        inventory.join(counts, ENTITY, "left")
        .withColumn("total_propiedades_activas", total.cast("int"))
        .select(*INVENTORY_SCHEMA.names)
    )
