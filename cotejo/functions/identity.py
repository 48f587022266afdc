"""Human keys and deterministic entity ids."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.operand import Operand
from cotejo.functions.text import to_text

DEFAULT_SEPARATOR = "|"
ANCHOR = "ANCLA:"  # fixed value: prefix of keys made from the row id


def human_key(parts: Sequence[Operand], separator: str = DEFAULT_SEPARATOR) -> Column:
    """Texts of the key columns in the given order; NULL and NaN count as empty."""
    texts = []
    for part in parts:
        text = to_text(part)
        if part.is_float:
            text = F.when(~F.isnan(part.column), text)
        texts.append(F.coalesce(text, F.lit("")))
    return F.concat_ws(separator, *texts)


def anchor_key(row_id: Operand) -> Column:
    return F.concat(F.lit(ANCHOR), to_text(row_id))


def with_entity_id(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Add the UUID version 5 of the key in the standard DNS namespace.

    The digest is a column of its own for a while, so that it is computed once per row. Give a
    key that cannot be NULL where the id is joined on: else Spark filters on the id not being
    NULL, and computes it over again for that.
    """
    digest = F.sha1(F.concat(F.lit(uuid.NAMESPACE_DNS.bytes), key.cast("binary")))
    return df.withColumn("__digest", digest).withColumn(name, _uuid5(F.col("__digest"))).drop("__digest")


def _uuid5(digest: Column) -> Column:
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )
