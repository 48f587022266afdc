"""Pivot of current vault rows to one typed row per entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.functions.cleaning import (
    is_numeric_type,
    number_digits,
    number_type,
    typed_value,
)
from cotejo.functions.operand import quoted
from cotejo.operators.state import CURRENT
from cotejo.sources.config import ConfigRow, kept_properties

ENTITY = "entidad_interna_id"
#: From so many properties on, a map per entity is cheaper than one condition per property and row.
MAP_FROM = 40


def _live(vault: DataFrame, source_table: str) -> DataFrame:
    return vault.filter((F.col("tabla_origen") == source_table) & (F.col("estado") == CURRENT))


def number_types(
    vault: DataFrame, config: Sequence[ConfigRow], *, source_table: str
) -> dict[str, str]:
    """The type that holds every number of each numeric property: one aggregate over the current
    rows, of which one row per property reaches the driver."""
    names = [r.columna_origen for r in kept_properties(config) if is_numeric_type(r.tipo_dato_generico)]
    if not names:
        return {}
    whole, decimals = number_digits(F.col("valor_limpio"))
    found = (
        _live(vault, source_table)
        .filter(F.col("propiedad_origen").isin(names))
        .groupBy("propiedad_origen")
        .agg(F.max(whole).alias("whole"), F.max(decimals).alias("decimals"))
        .collect()
    )
    needed = {row["propiedad_origen"]: (row["whole"], row["decimals"]) for row in found}
    return {name: number_type(*needed.get(name, (0, 0))) for name in names}


def _by_conditions(rows: DataFrame, names: Sequence[str], fixed: Sequence[Column]) -> DataFrame:
    """One conditional maximum per property."""
    values = [
        F.max(F.when(F.col("propiedad_origen") == name, F.col("valor_limpio"))).alias(name)
        for name in names
    ]
    return rows.groupBy(ENTITY).agg(*fixed, *values)


def _by_map(rows: DataFrame, names: Sequence[str], fixed: Sequence[Column]) -> DataFrame:
    """One map of values per entity, read once into a struct with a field per property.

    Rows are placed by entity once; both groupings stay there. Going through JSON finds each field
    by its hashed name, where looking up every property in the map would walk through all of it.
    """
    placed = rows.repartition(ENTITY)
    latest = placed.groupBy(ENTITY).agg(*fixed)
    wanted = placed.filter(F.col("propiedad_origen").isin(list(names)))
    best = wanted.groupBy(ENTITY, "propiedad_origen").agg(F.max("valor_limpio").alias("v"))
    entry = F.when(F.col("v").isNotNull(), F.struct("propiedad_origen", "v"))
    fields = T.StructType([T.StructField(name, T.StringType()) for name in names])
    entries = F.map_from_entries(F.collect_list(entry))
    read = F.from_json(F.to_json(entries), fields).alias("__values")
    maps = best.groupBy(ENTITY).agg(read)
    joined = latest.join(maps, ENTITY, "left")
    values = [F.col(f"__values.{quoted(name)}").alias(name) for name in names]
    return joined.select(*latest.columns, *values)


def wide_entities(
    vault: DataFrame,
    config: Sequence[ConfigRow],
    *,
    source_table: str,
    on_bad_number: str = "fail",
    scales: Mapping[str, int | str] | None = None,
    map_from: int = MAP_FROM,
) -> DataFrame:
    """One row per entity: key, origin and author of the latest value, then its properties.

    Origin and author come from the latest row, NULLs included; rows of one instant rank by
    property name, the order in which a run writes them. Numbers keep all their digits: unless
    ``scales`` gives the type or the decimals of a column, it is planned from the rows themselves.
    """
    properties = kept_properties(config)
    rows = _live(vault, source_table)
    scales = scales or {}
    open_types = [row for row in properties if row.columna_origen not in scales]
    kinds = number_types(vault, open_types, source_table=source_table) | dict(scales)
    latest = F.struct("desde", "propiedad_origen")
    fixed = [
        F.max("llave_humana_completa").alias("llave_humana_completa"),
        F.max_by("origen_dato", latest).alias("origen_dato"),
        F.max_by("creado_por", latest).alias("creado_por"),
        F.max("desde").alias("actualizado_en"),
    ]
    names = [row.columna_origen for row in properties]
    pivot = _by_map if len(names) >= map_from else _by_conditions
    grouped = pivot(rows, names, fixed)
    typed = [
        typed_value(
            F.col(quoted(row.columna_origen)),
            row.tipo_dato_generico,
            on_bad_number,
            kinds.get(row.columna_origen, "string"),
        ).alias(row.columna_origen)
        for row in properties
    ]
    return grouped.select(*grouped.columns[: 1 + len(fixed)], *typed)
