"""Versioned upsert of property records into the vault (slowly changing dimension, type 2).

Records of one property follow each other in run order. A record whose hash equals the one
before it changes nothing; any other closes the version before it. Closed versions never
change again, so only current ones take part.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.operators.outer_join import HOT_ROWS
from cotejo.operators.skew import is_among
from cotejo.operators.state import CLOSED, CURRENT, REMOVED, VAULT_SCHEMA
from cotejo.session import ensure_checkpoint_dir

CHANGE = "cambio"
RANGE_ROWS = 250_000  # records of a range, where hot entities have many ranges
KEPT, ENDED, DROPPED, INSERTED, UPDATED = "kept", "closed", "removed", "inserted", "updated"

PROPERTY = ["entidad_interna_id", "propiedad_origen"]
PAYLOAD = [
    "llave_humana_completa",
    "valor_original",
    "valor_limpio",
    "firma_auditoria",
    "tipo_dato_generico",
    "tabla_origen",
    "origen_dato",
    "creado_por",
]


def apply_changes(
    current: DataFrame,
    records: DataFrame,
    *,
    job_id: str,
    at: datetime,
    removed: DataFrame | None = None,
    source_table: str | None = None,
    hot: DataFrame | None = None,
    hot_records: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every vault row the run keeps, closes, removes or adds, labelled in ``cambio``.

    ``removed`` holds ids of entities whose current rows of ``source_table`` end in this run.
    Entities listed in ``hot`` (``value`` and their number of records, ``rows``) have too many for
    one task: theirs come apart, in ``hot_records``, not placed by entity, and are cut into ranges.
    """
    versions = _mark_removed(current, removed, source_table)
    if hot is None:
        return _labelled(_chained(versions, records), job_id, at)
    entity = F.col("entidad_interna_id")
    rest = is_among(versions, entity, hot, wanted=False)
    listed = is_among(versions, entity, hot, wanted=True)
    records_of_hot = hot.agg(F.sum("rows")).first()[0]
    ranges = max(8, -(-records_of_hot // max(hot_rows, RANGE_ROWS)))
    chained = _chained(rest, records).unionByName(
        _chained_in_ranges(listed, hot_records, ranges)
    )
    return _labelled(chained, job_id, at)


def apply_to_touched(
    current: DataFrame,
    records: DataFrame,
    touched: DataFrame,
    *,
    job_id: str,
    at: datetime,
    **hot,
) -> DataFrame:
    """``apply_changes`` for few records: entities not in ``touched`` are kept as they are.

    When Spark finds the touched ids small enough to broadcast, the rest is not shuffled.
    """
    rest = current.join(touched, "entidad_interna_id", "left_anti")
    changes = apply_changes(
        current.join(touched, "entidad_interna_id", "left_semi"),
        records.repartition("entidad_interna_id"),
        job_id=job_id,
        at=at,
        **hot,
    )
    return changes.unionByName(rest.select(*VAULT_SCHEMA.names, F.lit(KEPT).alias(CHANGE)))


def _mark_removed(
    current: DataFrame, removed: DataFrame | None, source_table: str | None
) -> DataFrame:
    """Current rows placed by entity: the one shuffle that join and chains need."""
    placed = current.repartition("entidad_interna_id")
    if removed is None:
        return placed.withColumn("gone", F.lit(False))
    marked = placed.join(
        removed.select("entidad_interna_id", F.lit(True).alias("listed")),
        "entidad_interna_id",
        "left",
    )
    gone = F.col("listed").isNotNull() & (F.col("tabla_origen") == source_table)
    return marked.withColumn("gone", F.coalesce(gone, F.lit(False))).drop("listed")


def _stored(current: DataFrame, records: DataFrame) -> DataFrame:
    return current.select(
        *PROPERTY,
        *PAYLOAD,
        "gone",
        "job_id",
        "desde",
        F.lit(None).cast(records.schema["orden"].dataType).alias("orden"),
        F.lit(False).alias("new"),
    )


def _arriving(records: DataFrame) -> DataFrame:
    return records.select(
        *PROPERTY,
        *PAYLOAD,
        F.lit(False).alias("gone"),
        F.lit(None).cast("string").alias("job_id"),
        F.lit(None).cast("timestamp").alias("desde"),
        "orden",
        F.lit(True).alias("new"),
    )


def _differs(before: Column, has_before: Column) -> Column:
    return ~has_before | (F.col("firma_auditoria") != before)


def _chained(current: DataFrame, records: DataFrame) -> DataFrame:
    """The current version leads the records of its property.

    Both sides are placed by entity already, so the windows need no further shuffle.
    """
    rows = _stored(current, records).unionByName(_arriving(records))
    chain = Window.partitionBy(*PROPERTY).orderBy("new", "orden")
    linked = rows.withColumns(
        {
            "before": F.lag("firma_auditoria").over(chain),
            "has_before": F.lag(F.lit(True), 1, False).over(chain),
        }
    )
    changed = linked.filter(~F.col("new") | _differs(F.col("before"), F.col("has_before")))
    return changed.withColumn("followed", F.lead(F.lit(True), 1, False).over(chain)).drop(
        "before"
    )


def _chained_in_ranges(current: DataFrame, records: DataFrame, ranges: int) -> DataFrame:
    """The same chain for properties with very many records.

    Records are range-partitioned by property and order, so one property spans several
    ranges. Each range is chained by itself; only its last hash, one row, links it to the next.
    The ranges are checkpointed because every later step must see the same cut.
    """
    spark = records.sparkSession
    ensure_checkpoint_dir(spark)
    arriving = _arriving(records).dropDuplicates()  # a copy never differs from its twin
    cut = (
        arriving.repartitionByRange(ranges, *PROPERTY, "orden")
        .withColumn("range", F.spark_partition_id())
        .checkpoint()
    )

    stored = _stored(current, records)
    tails = (
        cut.groupBy(*PROPERTY, "range")
        .agg(F.max_by("firma_auditoria", "orden").alias("tail"))
        .unionByName(
            stored.select(*PROPERTY, F.lit(-1).alias("range"), F.col("firma_auditoria").alias("tail"))
        )
    )
    along = Window.partitionBy(*PROPERTY).orderBy("range")
    starts = tails.select(
        *PROPERTY,
        "range",
        F.lag("tail").over(along).alias("start"),
        F.lag(F.lit(True), 1, False).over(along).alias("has_start"),
    ).filter("range >= 0")

    within = Window.partitionBy(*PROPERTY, "range").orderBy("orden")
    first = F.lag(F.lit(True), 1, False).over(within) == F.lit(False)
    linked = (
        cut.withColumns({"inner": F.lag("firma_auditoria").over(within), "first": first})
        .join(starts, [*PROPERTY, "range"])
        .withColumns(
            {
                "before": F.when(F.col("first"), F.col("start")).otherwise(F.col("inner")),
                "has_before": ~F.col("first") | F.col("has_start"),
            }
        )
    )
    changed = linked.filter(_differs(F.col("before"), F.col("has_before"))).withColumn(
        "followed", F.lead(F.lit(True), 1, False).over(within)
    )
    last = changed.groupBy(*PROPERTY).agg(F.max("range").alias("last_range"))
    columns = [*stored.columns, "has_before", "followed"]
    ended = F.col("followed") | (F.col("range") < F.col("last_range"))
    new = changed.join(last, PROPERTY).withColumn("followed", ended).select(*columns)
    old = (
        stored.join(last, PROPERTY, "left")
        .withColumns({"has_before": F.lit(False), "followed": F.col("last_range").isNotNull()})
        .select(*columns)
    )
    return old.unionByName(new)


def _labelled(chained: DataFrame, job_id: str, at: datetime) -> DataFrame:
    new, followed, gone = F.col("new"), F.col("followed"), F.col("gone")
    change = (
        F.when(new & F.col("has_before"), UPDATED)
        .when(new, INSERTED)
        .when(followed, ENDED)
        .when(gone, DROPPED)
        .otherwise(KEPT)
    )
    state = F.when(followed, CLOSED).when(gone, REMOVED).otherwise(CURRENT)
    touched = new | followed | gone
    values = {
        "estado": state,
        "job_id": F.when(touched, F.lit(job_id)).otherwise(F.col("job_id")),
        "desde": F.when(new, F.lit(at)).otherwise(F.col("desde")),
        "hasta": F.when(followed | gone, F.lit(at)),
    }
    columns = [values[name].alias(name) if name in values else name for name in VAULT_SCHEMA.names]
    return chained.select(*columns, change.alias(CHANGE))
