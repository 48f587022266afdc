"""Connected components of a table of links, as rounds of two star rewrites.

Every round replaces links by links to smaller neighbours until each node has one link, to the
smallest node of its component. Neighbours are only ever aggregated to a minimum or joined, never
gathered; each round is written to the shared folder, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import stored


def _to_larger(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest neighbour."""
    both = links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    )
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return (
        both.where("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _to_smaller(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them (a > b in links)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), "m")
    return (
        joined.unionByName(least).select("a", F.col("m").alias("b")).where("a <> b").distinct()
    )


def _mark(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")
    ).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for nodes that have links.

    ``links`` has two columns, in either order and with repeats; a link to itself counts as none.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns)
    current = stored(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where("a <> b")
        .distinct(),
        "links",
    )
    mark = _mark(current)
    while mark[0]:
        current = stored(_to_smaller(_to_larger(current)), "links")
        before, mark = mark, _mark(current)
        if before == mark:
            break
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
