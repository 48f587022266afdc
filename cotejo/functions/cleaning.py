"""Cleaning of source values by their configured type, and the hash of the clean value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.operand import Operand
from cotejo.functions.text import squeeze_blanks, strip, to_text

# The types cleaned as numbers, and the type that must not be empty.
NUMERIC_TYPES = ("numero", "superficie", "largo", "moneda", "porcentaje", "peso")
INTERNAL_ID = "internal_id"

NUMBER_SCALE = 10  # decimals of a number column unless told otherwise


def type_key(generic_type: str) -> str:
    return generic_type.strip().lower()


def is_numeric_type(generic_type: str) -> bool:
    return type_key(generic_type) in NUMERIC_TYPES


def is_empty(value: Operand) -> Column:
    """NULL, NaN or blank text."""
    if value.is_text:
        return value.column.isNull() | (strip(value.column) == "")
    if value.is_float:
        return value.column.isNull() | F.isnan(value.column)
    return value.column.isNull()


def with_clean_columns(df: DataFrame, raw: str, numeric: Column) -> DataFrame:
    """Add original value, clean value and hash of the raw texts in ``raw``.

    ``numeric`` tells which rows are cleaned as numbers. Each step is a column of its own, so
    that no pattern is searched twice.
    """
    text = F.col(raw)
    original = F.col("valor_original")
    cleaned = F.when(numeric, numeric_text(original)).otherwise(squeeze_blanks(original))
    return (
        df.withColumn("valor_original", F.when(strip(text) != "", text))
        .withColumn("__cleaned", cleaned)
        .withColumn("valor_limpio", F.nullif(F.col("__cleaned"), F.lit("")))
        .withColumn("firma_auditoria", audit_hash(F.col("valor_limpio")))
        .drop("__cleaned")
    )


def original_value(value: Operand) -> Column:
    return F.when(~is_empty(value), to_text(value))


def numeric_text(text: Column) -> Column:
    """Decimal commas become points; everything but digits, points and signs goes."""
    return F.regexp_replace(F.translate(text, ",", "."), "[^0-9.+-]", "")


def clean_value(value: Operand, generic_type: str) -> Column:
    """The clean text; NULL where nothing is left. An empty internal id is an error, see below."""
    text = to_text(value)
    cleaned = numeric_text(text) if is_numeric_type(generic_type) else squeeze_blanks(text)
    return F.nullif(F.when(~is_empty(value), cleaned), F.lit(""))


def clean_error(value: Operand, generic_type: str) -> Column:
    """Why the row cannot be cleaned, NULL when it can."""
    if type_key(generic_type) != INTERNAL_ID:
        return F.lit(None).cast("string")
    return F.when(clean_value(value, generic_type).isNull(), "internal_id must not be empty")


def audit_hash(clean: Column) -> Column:
    """SHA-256 of the clean text; NULL hashes like the empty text."""
    return F.sha2(F.coalesce(clean, F.lit("")), 256)


#: What is left of a number after cleaning, and is one: digits with at most one point and sign.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"
MOST_DIGITS = 38  # of a decimal; longer numbers stay texts


def number_digits(clean: Column) -> tuple[Column, Column]:
    """Digits before and after the point that the number needs, leading and trailing zeros not
    counted; NULL for what is no number."""
    number = F.when(clean.rlike(NUMBER), clean)
    whole = F.regexp_extract(number, r"^[+-]?0*([0-9]*)", 1)
    decimals = F.regexp_extract(number, r"[.]([0-9]*?)0*$", 1)
    return F.length(whole), F.length(decimals)


def number_type(whole: int | None, decimals: int | None) -> str:
    """The narrowest type that holds numbers of so many digits: a decimal, or text beyond 38."""
    whole, decimals = whole or 0, decimals or 0
    digits = max(1, whole + decimals)
    return f"decimal({digits},{decimals})" if digits <= MOST_DIGITS else "string"


def typed_value(
    clean: Column,
    generic_type: str,
    on_bad_number: str = "fail",
    scale: int | str = NUMBER_SCALE,
) -> Column:
    """The clean text as a number for numeric types, else unchanged.

    ``scale`` is the type from ``number_type``, which holds the numbers it was planned for, or a
    count of decimals for decimal(38, scale). A text that is no number, or one of more digits than
    the type holds, is a bad number. As text a number loses its plus sign and outer zeros.
    """
    if not is_numeric_type(generic_type):
        return clean
    digits = F.nullif(clean, F.lit(""))
    kind = f"decimal({MOST_DIGITS},{scale})" if isinstance(scale, int) else scale
    if kind == "string":
        number = F.when(digits.rlike(NUMBER), _plain(digits))
    else:
        held = int(kind.rstrip(")").split(",")[1])
        decimals = F.length(F.regexp_extract(digits, r"\.(\d*?)0*$", 1))
        number = F.when(decimals <= held, digits.try_cast(kind))
    if on_bad_number == "null":
        return number
    if on_bad_number != "fail":
        raise ValueError("on_bad_number must be 'fail' or 'null'")
    message = F.concat(F.lit(f"not a number of type {kind}: "), digits)
    return F.when(digits.isNotNull() & number.isNull(), F.raise_error(message)).otherwise(number)


def _plain(digits: Column) -> Column:
    sign = F.when(digits.startswith("-"), "-").otherwise("")
    whole = F.regexp_extract(digits, r"^[+-]?0*([0-9]*)", 1)
    decimals = F.regexp_extract(digits, r"[.]([0-9]*?)0*$", 1)
    number = F.concat(
        F.when(whole == "", "0").otherwise(whole),
        F.when(decimals == "", "").otherwise(F.concat(F.lit("."), decimals)),
    )
    return F.when(number == "0", "0").otherwise(F.concat(sign, number))
