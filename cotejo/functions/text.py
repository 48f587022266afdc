"""Text forms of values and text normalization."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.functions.operand import Operand

# The characters that count as blank when a text is stripped or its blanks are squeezed.
BLANKS = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
_BLANK = r"\s\x1c-\x1f"  # the same characters as a class, with Unicode classes on
# a run of blanks other than one plain space, which needs no replacement
_BLANK_RUN = rf"(?U) [{_BLANK}]+|[{_BLANK}&&[^ ]][{_BLANK}]*"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def squeeze_blanks(text: Column) -> Column:
    """One space for every run of blanks, none at the ends."""
    return F.btrim(F.regexp_replace(text, _BLANK_RUN, " "))


def to_text(value: Operand) -> Column:
    """The text a value has in keys, hashes and edit distances.

    Booleans read ``True``/``False``, whole doubles keep ``.0``, and exponents appear only
    below 1e-4 and from 1e16 on, written ``1e-05`` and ``1e+16``.
    """
    column, dtype = value.column, value.dtype
    if value.is_text:
        return column
    if value.is_bool:
        return F.when(column, F.lit("True")).when(~column, F.lit("False"))
    if isinstance(dtype, T.DoubleType):
        return _double_text(column)
    if isinstance(dtype, T.FloatType):
        return _double_text(column.cast("string").cast("double"))
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        whole = F.regexp_replace(column.cast("string"), r"0+$", "")
        return F.when(whole.endswith("."), F.concat(whole, F.lit("0"))).otherwise(whole)
    if isinstance(dtype, T.TimestampNTZType):
        return _timestamp_text(column)
    if isinstance(dtype, T.TimestampType):
        return F.concat(_timestamp_text(column), F.date_format(column, "xxx"))
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def _double_text(column: Column) -> Column:
    plain = column.cast("string")
    size = F.abs(column)
    no_number = F.isnan(column) | (size == float("inf"))
    decimal = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    digits = F.regexp_replace(column.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    return (
        F.when(((size >= 1e-3) & (size < 1e7)) | (column == 0), plain)
        .when(no_number, F.regexp_replace(F.lower(plain), "inity", ""))
        .when(decimal, digits)
        .when(column.isNotNull(), F.regexp_replace(_shortest(column), r"\.?0*e", "e"))
    )


def _shortest(column: Column) -> Column:
    """The fewest digits that read back as the same double; Java may print more."""
    fewer, few, all_digits = (F.format_string(f"%.{n}e", column) for n in (14, 15, 16))
    return (
        F.when(fewer.try_cast("double") == column, fewer)
        .when(few.try_cast("double") == column, few)
        .otherwise(all_digits)
    )


def _timestamp_text(column: Column) -> Column:
    seconds = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    micros = F.date_format(column, "SSSSSS")
    return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))


def key_text(value: Operand) -> Column:
    """The text of a join key as the database prints it."""
    if value.is_float:
        return F.regexp_replace(to_text(value), r"\.0$", "")
    if isinstance(value.dtype, T.TimestampType):
        return F.concat(value.column.cast("string"), F.lit("+00"))
    return value.column.cast("string")


def _fold(text: str) -> str:
    folded = unicodedata.normalize("NFKD", text.strip().lower())
    for mark in filter(unicodedata.combining, set(folded)):
        folded = folded.replace(mark, "")
    return folded


@F.pandas_udf(T.StringType())
def _fold_batch(texts: pd.Series) -> pd.Series:
    return texts.map(_fold, na_action="ignore")


def normalize_text(text: Column) -> Column:
    """Strip, lower case, compatibility decomposition, combining marks dropped.

    ASCII texts stay in the JVM; only the others go to Python.
    """
    ascii_only = F.octet_length(text) == F.length(text)
    folded = _fold_batch(F.when(~ascii_only, text))
    return F.when(ascii_only, F.lower(strip(text))).otherwise(folded)
