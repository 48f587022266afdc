"""Schemas and fixed values of the vault and the entity inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# States of vault rows and of entities, and origins of a value.
CURRENT, CLOSED, REMOVED = "VIGENTE", "HISTORICO", "ELIMINADO"
ACTIVE, INACTIVE = "ACTIVO", "INACTIVO"
BULK_LOAD, MANUAL_EDIT = "carga_masiva", "edicion_manual"


def _fields(names: str, dtype: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, dtype) for name in names.split()]


VAULT_SCHEMA = T.StructType(
    _fields(
        "entidad_interna_id llave_humana_completa propiedad_origen valor_original valor_limpio "
        "firma_auditoria tipo_dato_generico tabla_origen origen_dato creado_por estado job_id",
        T.StringType(),
    )
    + _fields("desde hasta", T.TimestampType())
)

INVENTORY_SCHEMA = T.StructType(
    _fields("entidad_interna_id llave_humana_completa tabla_origen estado_entidad", T.StringType())
    + _fields("total_propiedades_activas", T.IntegerType())
    + _fields("actualizado_en", T.TimestampType())
    + _fields("job_id", T.StringType())
)

# Values of columns that an older table lacks; every other column becomes NULL.
DEFAULTS = {
    "entidad_interna_id": "",
    "propiedad_origen": "",
    "firma_auditoria": "",
    "origen_dato": BULK_LOAD,
    "estado": CURRENT,
    "estado_entidad": ACTIVE,
    "total_propiedades_activas": 0,
}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table without rows that the optimizer knows to be empty."""
    columns = [F.lit(None).cast(field.dataType).alias(field.name) for field in schema]
    return spark.range(1).filter(F.lit(False)).select(*columns)


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema in order and type; missing ones get their default."""
    columns = []
    for field in schema:
        if field.name in df.columns:
            column = F.col(field.name)
        else:
            default = "" if field.name == "tabla_origen" and schema is INVENTORY_SCHEMA else None
            column = F.lit(DEFAULTS.get(field.name, default))
        columns.append(column.cast(field.dataType).alias(field.name))
    return df.select(*columns)
