import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from cotejo.functions import cleaning, identity
from cotejo.functions.operand import operand


def one(spark, value, build, dtype="string"):
    df = spark.createDataFrame([(value,)], f"a {dtype}")
    return df.select(build(operand(df, "a"))).first()[0]


@pytest.mark.parametrize(
    ("value", "kind", "expected"),
    [
        ("12,5 m²", "superficie", "12.5"),
        ("1.234,56", "numero", "1.234.56"),
        ("  texto   con   espacios  ", "texto", "texto con espacios"),
        ("10%", "porcentaje", "10"),
        ("$1.200,50", " Moneda ", "1.200.50"),
        ("abc-12,34xyz", "peso", "-12.34"),
        (" ABC-123 ", "internal_id", "ABC-123"),
        ("kg", "peso", None),
        (None, "texto", None),
        (" \t", "texto", None),
    ],
)
def test_clean_values(spark, value, kind, expected):
    assert one(spark, value, lambda v: cleaning.clean_value(v, kind)) == expected
    df = spark.createDataFrame([(value,)], "raw string")
    row = cleaning.with_clean_columns(df, "raw", F.lit(cleaning.is_numeric_type(kind))).first()
    assert row["valor_limpio"] == expected
    assert row["firma_auditoria"] == hashlib.sha256((expected or "").encode()).hexdigest()


def test_internal_id_must_not_be_empty(spark):
    assert one(spark, "  ", lambda v: cleaning.clean_error(v, "internal_id"))
    assert one(spark, "x", lambda v: cleaning.clean_error(v, "internal_id")) is None
    assert one(spark, None, lambda v: cleaning.clean_error(v, "texto")) is None


def test_original_values(spark):
    assert one(spark, " 12,5 m² ", cleaning.original_value) == " 12,5 m² "
    assert one(spark, "   ", cleaning.original_value) is None
    assert one(spark, float("nan"), cleaning.original_value, "double") is None
    assert one(spark, 10.0, cleaning.original_value, "double") == "10.0"
    assert one(spark, True, cleaning.original_value, "boolean") == "True"


def test_typed_values(spark):
    assert float(one(spark, "12.5", lambda v: cleaning.typed_value(v.column, "peso"))) == 12.5
    assert one(spark, "", lambda v: cleaning.typed_value(v.column, "peso")) is None
    assert one(spark, "1.2.3", lambda v: cleaning.typed_value(v.column, "peso", "null")) is None
    with pytest.raises(Exception, match="not a number"):
        one(spark, "1.2.3", lambda v: cleaning.typed_value(v.column, "peso"))


def test_keys_and_ids(spark):
    df = spark.createDataFrame(
        [("P-001", "Norte", 42), ("ñ", None, None)], "codigo string, zona string, id int"
    )
    parts = [operand(df, "codigo"), operand(df, "zona")]
    named = identity.with_entity_id(
        df.withColumn("key", identity.human_key(parts)), F.col("key"), "entity"
    ).withColumn("anchor", identity.anchor_key(operand(df, "id")))
    rows = named.collect()
    assert [r["key"] for r in rows] == ["P-001|Norte", "ñ|"]
    assert [r["entity"] for r in rows] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, r["key"])) for r in rows]
    assert [r["anchor"] for r in rows] == ["ANCLA:42", None]
