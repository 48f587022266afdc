"""From wide source rows to identified, cleaned property records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.functions.cleaning import (
    clean_error,
    is_numeric_type,
    with_clean_columns,
)
from cotejo.functions.identity import DEFAULT_SEPARATOR, anchor_key, human_key, with_entity_id
from cotejo.functions.operand import Operand, operand, quoted
from cotejo.functions.text import strip, to_text
from cotejo.operators.state import BULK_LOAD
from cotejo.sources.config import ConfigRow, kept_properties

ROW_ID = "id"  # fixed value: the source column that identifies rows without key columns
KEY, ENTITY, ERROR, ORDER = "__key", "__entity", "__error", "__order"  # added to source rows
TEXT, DOUBLE = T.StringType(), T.DoubleType()


def row_key(source: DataFrame, config: Sequence[ConfigRow], separator: str) -> Column:
    """Key columns in alphabetical order, or the anchored row id; NULL when there is none."""
    names = sorted(row.columna_origen for row in config if row.es_llave)
    if names:
        absent = Operand(F.lit(""), TEXT)
        parts = [operand(source, n) if n in source.columns else absent for n in names]
        return human_key(parts, separator)
    if ROW_ID in source.columns:
        return anchor_key(operand(source, ROW_ID))
    return F.lit(None).cast("string")


def has_key() -> Column:
    return F.col(KEY).isNotNull() & (strip(F.col(KEY)) != "")


def stored_ids(inventory: DataFrame, source_table: str) -> DataFrame | None:
    """Keys whose stored id is not the derived one: mostly none, so no lookup join is needed."""
    listed = inventory.filter(F.col("tabla_origen") == source_table).select(
        F.col("llave_humana_completa").alias("known_key"), F.col("entidad_interna_id").alias("id")
    )
    stored = (
        with_entity_id(listed, F.col("known_key"), "derived")
        .filter("id <> derived")
        .groupBy("known_key")
        .agg(F.min("id").alias("known_id"))
    )
    return None if stored.isEmpty() else stored


def identified(
    source: DataFrame,
    config: Sequence[ConfigRow],
    known: DataFrame | None,
    *,
    separator: str = DEFAULT_SEPARATOR,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Source rows with human key, entity id, order within the run and error text.

    The id of a row without key means nothing; ``has_key`` tells them apart.

    ``known`` holds the ids that replace derived ones. Rows of one entity are ordered by
    ``order_by``; ties by the hash of the configured columns, as rows alike in those are equal.
    """
    kept = [row for row in kept_properties(config) if row.columna_origen in source.columns]
    errors = [F.when(~has_key(), F.lit("the row has no key"))]
    errors += [clean_error(operand(source, r.columna_origen), r.tipo_dato_generico) for r in kept]
    hashed = [quoted(row.columna_origen) for row in kept] or [KEY]
    order = F.struct(
        *[F.col(quoted(name)).alias(f"o{i}") for i, name in enumerate(order_by)],
        F.xxhash64(*hashed).alias("tie"),
    )
    keyed = source.withColumn(KEY, row_key(source, config, separator))
    marked = keyed.withColumn(ERROR, F.coalesce(*errors)).withColumn(ORDER, order)
    derived = with_entity_id(marked, F.coalesce(KEY, F.lit("")), ENTITY)
    if known is None:
        return derived
    return (
        derived.join(known, F.col(KEY) == F.col("known_key"), "left")
        .withColumn(ENTITY, F.coalesce("known_id", ENTITY))
        .drop("known_key", "known_id")
    )


def property_records(
    rows: DataFrame,
    config: Sequence[ConfigRow],
    *,
    source_table: str,
    origin: str = BULK_LOAD,
    placed: bool = True,
) -> DataFrame:
    """One record per kept property of each faultless row: original, clean, hash and type.

    The wide rows are placed by entity before they are unpivoted, so one shuffle of the
    narrower form serves the version chains too; not so the rows of entities with very many.
    """
    kept = [row for row in kept_properties(config) if row.columna_origen in rows.columns]
    if not kept:
        raise ValueError("the source has none of the configured properties")
    values = {row.columna_origen: operand(rows, row.columna_origen) for row in kept}
    carried = [
        (value.column.cast(DOUBLE) if value.is_float else to_text(value)).alias(f"p{i}")
        for i, value in enumerate(values.values())
    ]
    narrow = rows.filter(F.col(ERROR).isNull()).select(
        F.col(ENTITY).alias("entidad_interna_id"),
        F.col(KEY).alias("llave_humana_completa"),
        F.col(ORDER).alias("orden"),
        *carried,
    )
    if placed:
        narrow = narrow.repartition("entidad_interna_id")
    # floating values become text after the unpivot: one conversion, however many columns
    properties = []
    for i, row in enumerate(kept):
        floating = values[row.columna_origen].is_float
        properties.append(
            F.struct(
                F.lit(row.columna_origen).alias("propiedad_origen"),
                F.lit(None if floating else F.col(f"p{i}")).cast(TEXT).alias("raw"),
                F.lit(F.col(f"p{i}") if floating else None).cast(DOUBLE).alias("number"),
                F.lit(row.tipo_dato_generico).alias("tipo_dato_generico"),
                F.lit(is_numeric_type(row.tipo_dato_generico)).alias("numeric"),
            )
        )
    unpivoted = narrow.select(
        "entidad_interna_id", "llave_humana_completa", "orden", F.inline(F.array(*properties))
    )
    if any(value.is_float for value in values.values()):
        number = F.when(~F.isnan("number"), to_text(Operand(F.col("number"), DOUBLE)))
        unpivoted = unpivoted.withColumn("raw", F.coalesce("raw", number))
    constants = {
        "tabla_origen": F.lit(source_table),
        "origen_dato": F.lit(origin),
        "creado_por": F.lit(None).cast("string"),
    }
    cleaned = with_clean_columns(unpivoted, "raw", F.col("numeric"))
    return cleaned.withColumns(constants).drop("raw", "number", "numeric")


def counted_entities(tagged: DataFrame, accepted: str, *, shared_ids: bool = False) -> DataFrame:
    """What a run needs to know of its source besides the records, from one pass over it.

    One row per entity of accepted rows with a key (id, latest key, whether a faultless row had
    it), and one each, without id, for accepted rows without key and for rejected rows; all with
    their number of rows and of errors. ``accepted`` names the flag of the rows.
    """
    known = F.col(accepted) & has_key()
    by = ENTITY if shared_ids else KEY
    # where ids follow from keys, an entity has one key: no need to look for its latest
    latest = [F.max_by(KEY, F.struct(ORDER, KEY)).alias("key")] if shared_ids else []
    grouped = tagged.groupBy(F.col(accepted), F.when(known, F.col(by)).alias("by")).agg(
        *latest,
        F.max(F.col(ERROR).isNull()).alias("faultless"),
        F.count(F.lit(1)).alias("rows"),
        F.count(ERROR).alias("errors"),
    )
    derived = grouped
    if shared_ids:
        derived = grouped.withColumn("id", F.col("by"))
    else:
        derived = with_entity_id(grouped, F.coalesce("by", F.lit("")), "id")
    has_id = F.col("by").isNotNull()
    return derived.select(
        F.when(has_id, F.col("id")).alias("entidad_interna_id"),
        F.when(has_id, F.col("key" if shared_ids else "by")).alias("llave_humana_completa"),
        "faultless",
        F.col(accepted).alias("accepted"),
        "rows",
        "errors",
    )
