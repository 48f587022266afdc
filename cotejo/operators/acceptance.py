"""Acceptance of source rows by their ``req_aceptado`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.coerce import to_bool
from cotejo.functions.operand import operand

ACCEPTED = "req_aceptado"  # fixed value


def acceptance_column(df: DataFrame) -> str | None:
    return next((name for name in df.columns if name.lower() == ACCEPTED), None)


def is_accepted(df: DataFrame) -> Column:
    """True for accepted rows, never NULL; every row when the source has no such column."""
    name = acceptance_column(df)
    if name is None:
        return F.lit(True)
    return F.coalesce(to_bool(operand(df, name)), F.lit(False))


def accepted(df: DataFrame) -> DataFrame:
    name = acceptance_column(df)
    if name is None:
        return df
    value = operand(df, name)
    # a plain boolean filter reaches the scan
    return df.filter(value.column if value.is_bool else is_accepted(df))


def acceptance_flag(df: DataFrame, name: str) -> DataFrame:
    """The rows with a column that tells whether they are accepted."""
    return df.withColumn(name, is_accepted(df))


def rejected_count(df: DataFrame) -> DataFrame:
    """One row: how many rows are not accepted."""
    return df.agg(F.count_if(~is_accepted(df)).alias("filas_omitidas"))
