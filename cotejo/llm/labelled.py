"""Held-out rows and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import text_of


def part_of(id_col: str, parts: int) -> Column:
    """The row's part by the CRC-32 of its id as text; NULL ids are in part 0."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.crc32(name), F.lit(parts))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    per_class: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """At most ``per_class`` documents of each of the labels 0 and 1: ``label`` and ``text``.

    The rows with the least hash of their id are taken, so a run again takes the same ones.
    """
    order = [F.xxhash64(F.lit(7), F.col(id_col)), F.col(id_col)]
    one_each = labels.select(id_col, F.col(label_col).cast("int").alias("label")).distinct()
    chosen = [
        one_each.where((F.col("label") == value) & F.col(id_col).isNotNull())
        .orderBy(*order)
        .limit(per_class)
        for value in (0, 1)
    ]
    both = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * per_class rows of two numbers
    return docs.select(id_col, text_of(text_col).alias("text")).join(both, id_col)
