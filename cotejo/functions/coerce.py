"""Lenient conversions of columns to numbers, booleans, lists and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.functions.operand import Operand
from cotejo.functions.text import strip, to_text

# Texts that count as true.
TRUE_WORDS = ("1", "true", "t", "yes", "y", "si", "sí")

# Fixed formats: number texts (digits may be grouped by single underscores) and ISO instants.
NUMBER = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
INFINITE = r"^(?i)[+-]?inf(inity)?$"
NOT_A_NUMBER = r"^(?i)[+-]?nan$"
ISO_INSTANT = "yyyy-MM-dd['T'HH[:mm[:ss[.SSSSSS][.SSS]]]]XXX"
BAD_FRACTION = r":\d{2}\.(?!\d{3}(\d{3})?(?!\d))"  # seconds have 3 or 6 decimals

MILLISECONDS_FROM = 1e12  # larger numbers are milliseconds, others seconds
DAY_MICROS = 86_400_000_000
FIRST_MICRO, LAST_MICRO = -62_135_596_800_000_000, 253_402_300_799_999_999  # the years 1 to 9999


def null_of(dtype: str) -> Column:
    return F.lit(None).cast(dtype)


def drop_nan(value: Operand) -> Operand:
    """NaN of a floating column read as NULL."""
    if not value.is_float:
        return value
    return Operand(F.when(~F.isnan(value.column), value.column), value.dtype)


def to_float(value: Operand) -> Column:
    if value.is_number or value.is_bool:
        return value.column.cast("double")
    if not value.is_text:
        return null_of("double")
    text = strip(value.column)
    number = F.regexp_replace(text, "_", "").try_cast("double")
    return F.when(text.rlike(NUMBER) | text.rlike(INFINITE), number).when(
        text.rlike(NOT_A_NUMBER), F.lit(float("nan"))
    )


def to_bool(value: Operand) -> Column:
    """True, false, or NULL for NULL."""
    column = value.column
    if value.is_bool:
        return column
    if value.is_number:
        return column != 0
    if value.is_text:
        return F.lower(strip(column)).isin(*TRUE_WORDS)
    if value.is_array:
        return F.when(column.isNotNull(), F.size(column) > 0)
    return F.when(column.isNotNull(), F.lit(True))


def to_list(value: Operand) -> Operand:
    """An array: JSON array text, else comma-separated items, else one item; NULL is empty."""
    column = value.column
    if value.is_array:
        empty = F.array().cast(value.dtype)
        return Operand(F.coalesce(column, empty), value.dtype)
    if value.is_text:
        strings = T.ArrayType(T.StringType())
        trimmed = strip(column)
        parsed = F.when(trimmed.rlike(r"^(?s)\[.*\]$"), _json_items(trimmed))
        items = F.transform(F.split(column, ",", -1), strip)
        listed = F.filter(items, lambda item: item != "")
        return Operand(F.coalesce(parsed, listed, F.array().cast(strings)), strings)
    dtype = T.ArrayType(value.dtype)
    single = F.when(column.isNotNull(), F.array(column)).otherwise(F.array().cast(dtype))
    return Operand(single, dtype)


def _variants(text: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")


def _json_items(text: Column) -> Column:
    """Texts of the items of a JSON array, NULL if it is none.

    Texts are taken as they are, null is NULL, other values have the form of to_text; lists and
    objects are written as JSON with sorted keys.
    """

    def item_text(item: Column) -> Column:
        kind = F.schema_of_variant(item)
        double = F.try_variant_get(item, "$", "double")
        return (
            F.when(kind == "VOID", null_of("string"))
            .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(item, "$", "string")))
            .when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), to_text(Operand(double, T.DoubleType())))
            .when(kind.rlike("^(OBJECT|ARRAY)"), F.to_json(item))
            .otherwise(F.try_variant_get(item, "$", "string"))
        )

    return F.transform(_variants(text), item_text)


def _double_key(double: Column) -> Column:
    """A whole number as its digits, as far as a decimal holds them."""
    digits = double.try_cast("decimal(38,0)")
    whole = digits.cast("double") == double
    return F.when(whole, digits.cast("string")).otherwise(double.cast("string"))


def _number_key(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return column.cast("int").cast("string")
    if isinstance(dtype, T.DecimalType) and dtype.scale:
        return F.when(
            column == F.floor(column), F.floor(column).cast("decimal(38,0)").cast("string")
        ).otherwise(_double_key(column.cast("double")))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _double_key(column.cast("double"))
    return column.cast("string")


def _json_keys(text: Column) -> Column:
    def key(item: Column) -> Column:
        kind = F.schema_of_variant(item)
        double = F.try_variant_get(item, "$", "double")
        texts = F.try_variant_get(item, "$", "string")
        return (
            F.when(kind == "VOID", F.lit("null"))
            .when(kind == "BOOLEAN", F.when(texts == "true", "n1").otherwise("n0"))
            .when(kind == "STRING", F.concat(F.lit("t"), texts))
            .when(kind.rlike("^(OBJECT|ARRAY)"), F.concat(F.lit("j"), F.to_json(item)))
            .when(
                kind.rlike(r"^(DOUBLE|FLOAT|DECIMAL\(\d+,[1-9])"),
                F.concat(F.lit("n"), _double_key(double)),
            )
            .otherwise(F.concat(F.lit("n"), texts))
        )

    return F.transform(_variants(text), key)


def item_keys(value: Operand) -> Column:
    """For each item of ``to_list`` a text that equal values share and others do not: ``1``, ``1.0``
    and true are one number, the text ``"1"`` is another value, null equals null."""
    listed = to_list(value)
    if value.is_text:
        trimmed = strip(value.column)
        parsed = F.when(trimmed.rlike(r"^(?s)\[.*\]$"), _json_keys(trimmed))
        plain = F.transform(listed.column, lambda item: F.concat(F.lit("t"), item))
        return F.coalesce(parsed, plain)
    dtype = listed.dtype.elementType
    family = Operand(value.column, dtype).family

    def key(item: Column) -> Column:
        if family == "number":
            known = F.concat(F.lit("n"), _number_key(item, dtype))
        elif family == "text":
            known = F.concat(F.lit("t"), item)
        elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
            known = F.concat(F.lit("j"), F.to_json(item))
        else:
            known = F.concat(F.lit(f"{family} "), item.cast("string"))
        return F.coalesce(known, F.lit("null"))

    return F.transform(listed.column, key)


def holds_nested_json(value: Operand) -> Column:
    """Whether a text is a JSON array with lists or objects among its items."""
    if not value.is_text:
        return F.lit(False)
    trimmed = strip(value.column)
    items = _variants(trimmed)
    nested = F.exists(items, lambda item: F.schema_of_variant(item).rlike("^(OBJECT|ARRAY)"))
    return F.coalesce(trimmed.startswith("[") & nested, F.lit(False))


def to_epoch_micros(value: Operand) -> Column:
    """Microseconds since 1970 UTC, NULL where the value is no instant.

    Working on numbers keeps every date method independent of the session time zone.
    """
    column, dtype = value.column, value.dtype
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(dtype, T.TimestampNTZType):
        epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
        return F.timestamp_diff("MICROSECOND", epoch, column)
    if isinstance(dtype, T.DateType):
        return F.unix_date(column).cast("bigint") * F.lit(DAY_MICROS)
    if value.is_number or value.is_bool:
        return _epoch_number(column.cast("double"))
    if not value.is_text:
        return null_of("bigint")
    text = strip(column)
    # any separator becomes T; a missing zone or a Z becomes the offset of UTC
    separated = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})(?s:.)(\d{2}.*)$", "$1T$2")
    zoned = F.regexp_replace(separated, r"^(\d{4}-\d{2}-\d{2}(?:T[\d:.]+)?)[zZ]?$", "$1+00:00")
    instant = F.unix_micros(F.try_to_timestamp(zoned, F.lit(ISO_INSTANT)))
    number = _epoch_number(column.try_cast("double"))
    return F.when(text.rlike(r"^\d+$"), number).when(~text.rlike(BAD_FRACTION), instant)


def _epoch_number(number: Column) -> Column:
    unit = F.when(F.abs(number) > MILLISECONDS_FROM, F.lit(1e3)).otherwise(F.lit(1e6))
    micros = F.rint(number * unit)
    return F.when(micros.between(FIRST_MICRO, LAST_MICRO), micros.cast("bigint"))


def day_start(micros: Column) -> Column:
    return micros - F.pmod(micros, F.lit(DAY_MICROS))
