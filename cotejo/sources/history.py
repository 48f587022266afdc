"""Append-only result tables, numbered by run."""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.functions.operand import quoted
from cotejo.sources.claims import claim_next

logger = logging.getLogger(__name__)

# The metadata columns in the order they close a result table.
METADATA = (
    "run_id",
    "created_at",
    "timestamp",
    "job_id",
    "estado_cruce",
    "analysis_id",
    "analysis_name",
    "source",
)


def next_run_id(spark: SparkSession, table: str) -> int:
    """One more than the highest run; 1 when the table is absent, empty or has no runs.

    Runs are partitions, so the number comes from the catalog and no file is read.
    """
    if not spark.catalog.tableExists(table):
        return 1
    try:
        if _partitioned_by_run(spark, table):
            number = F.regexp_extract("partition", r"run_id=(\d+)", 1).try_cast("bigint")
            runs = spark.sql(f"SHOW PARTITIONS {table}").agg(F.max(number))
        else:
            runs = spark.table(table).agg(F.max("run_id"))
        return int(runs.first()[0] or 0) + 1
    except AnalysisException as problem:
        logger.info("no run numbers readable in %s: %s", table, problem)
        return 1


def claim_run_id(spark: SparkSession, table: str) -> int:
    """The next run number, claimed: two jobs that ask at the same time get different ones.

    Claims are files beside the tables of the database. A number that was claimed and not used, as
    by a run that died, is not given again.
    """
    database, _, name = table.replace("`", "").lower().rpartition(".")
    place = spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri
    return claim_next(spark, f"{place}/_runs/{name}", next_run_id(spark, table) - 1)


def _partitioned_by_run(spark: SparkSession, table: str) -> bool:
    return any(c.name == "run_id" and c.isPartition for c in spark.catalog.listColumns(table))


def stamp(
    df: DataFrame,
    run_id: int | str,
    created_at: datetime,
    *,
    source: str | None = None,
    job_id: str | None = None,
    analysis_id: str | None = None,
    analysis_name: str | None = None,
) -> DataFrame:
    """Add the run constants; the ids and the analysis name only when given."""
    number = F.lit(run_id).cast("bigint") if isinstance(run_id, int) else F.lit(run_id)
    constants = {
        "run_id": number,
        "created_at": F.lit(created_at),
        "timestamp": F.lit(created_at),
    }
    optional = {"job_id": job_id, "analysis_id": analysis_id, "analysis_name": analysis_name}
    constants.update({name: F.lit(value) for name, value in optional.items() if value})
    constants["source"] = F.lit(source)
    return df.withColumns(constants)


def metadata_last(df: DataFrame) -> DataFrame:
    """Data columns first, then the metadata columns in their fixed order."""
    meta = [name for name in METADATA if name in df.columns]
    data = [name for name in df.columns if name not in meta]
    return df.select(*[quoted(name) for name in data + meta])


def add_missing_columns(df: DataFrame, table: str) -> bool:
    """Widen the table by columns it lacks; nothing is dropped or retyped."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        return False
    known = {name.lower() for name in spark.table(table).columns}
    new = [field for field in df.schema if field.name.lower() not in known]
    if not new:
        return False
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in new)
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")
    logger.info("%d new columns in %s", len(new), table)
    return True


#: Types whose values a type further right holds without loss.
_WIDER = {
    "tinyint": ("smallint", "int", "bigint", "float", "double"),
    "smallint": ("int", "bigint", "float", "double"),
    "int": ("bigint", "double"),
    "float": ("double",),
    "date": ("timestamp", "timestamp_ntz"),
}


def _holds(table: T.DataType, given: T.DataType) -> bool:
    """Whether a column of the table's type takes every value of the given type unchanged."""
    wanted, kind = table.simpleString(), given.simpleString()
    if wanted == kind or isinstance(given, T.NullType):
        return True
    if isinstance(table, T.DecimalType):
        whole = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
        if isinstance(given, T.DecimalType):
            needed, scale = given.precision - given.scale, given.scale
        else:
            needed, scale = whole.get(kind, 99), 0
        return table.scale >= scale and table.precision - table.scale >= needed
    return wanted in (_WIDER.get(kind, ()))


def _check_types(df: DataFrame, table: str) -> None:
    given = {field.name.lower(): field.dataType for field in df.schema}
    for field in df.sparkSession.table(table).schema:
        kind = given.get(field.name.lower())
        if kind is not None and not _holds(field.dataType, kind):
            raise TypeError(
                f"{table}.{field.name} is {field.dataType.simpleString()} and would lose values "
                f"of type {kind.simpleString()}"
            )


def append(df: DataFrame, table: str) -> bool:
    """Append by column name, creating or widening the table; tells if its schema changed.

    A column whose type cannot hold the new values unchanged is an error, before any change.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        try:
            df.write.format("parquet").partitionBy("run_id").saveAsTable(table)
            return True
        except AnalysisException as problem:
            if problem.getCondition() != "TABLE_OR_VIEW_ALREADY_EXISTS":
                raise  # else another job has made it meanwhile
    _check_types(df, table)
    changed = add_missing_columns(df, table)
    given = {name.lower() for name in df.columns}
    columns = [
        F.col(quoted(field.name))
        if field.name.lower() in given
        else F.lit(None).cast(field.dataType).alias(field.name)
        for field in spark.table(table).schema
    ]
    df.select(*columns).write.insertInto(table)
    return changed


def read_run(spark: SparkSession, table: str, run_id: int) -> DataFrame:
    """The rows of one run; other runs' partitions are not read."""
    return metadata_last(spark.table(table).filter(F.col("run_id") == run_id))
