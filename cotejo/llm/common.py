"""Small helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: blank and the bytes 09 to 0D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder that the cluster names in spark.checkpoint.dir.

    Only a local master, whose tasks share the driver's disk, may leave the setting out.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        shared = tempfile.mkdtemp(prefix="cotejo-llm-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows written once to the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    folder = scratch_folder(spark, name)
    df.write.parquet(folder, compression=compression)
    return spark.read.schema(df.schema).parquet(folder)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it.

    An expression used inside the lambda of a higher-order function would be computed once per
    element; the optimizer merges projections without knowing that.
    """
    return F.transform(F.array(value), body)[0]


def text_of(column: str) -> Column:
    """A text column with NULL as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, any other character as it is."""
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """Maximal runs of characters that are not white space, as an array."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.split(inner, SPACE_PATTERN, -1)
    )


def row_key(*columns: Column) -> Column:
    """128 bits that stand for the values of a row; equal rows share them."""
    return F.struct(
        F.xxhash64(F.lit(1), *columns).alias("k1"), F.xxhash64(F.lit(2), *columns).alias("k2")
    )


def text_hash(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def with_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind the others; a column of the same name (in any case) is replaced."""
    taken = {name.lower() for name in columns}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *(value.alias(name) for name, value in columns.items()))
