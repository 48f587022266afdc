"""Exact detection of values that hold very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.operators.outer_join import HOT_ROWS
from cotejo.session import written

#: Counts of hashes that bound the counts of values, as many for each value that could be hot.
GROUPS_PER_VALUE, MOST_GROUPS = 8, 1 << 20
MOST_LISTED = 1000  # of those, as many as a filter names


def hot_values(
    df: DataFrame,
    column: Column,
    hot_rows: int | None = None,
    within: DataFrame | None = None,
    alike: Column | None = None,
) -> DataFrame | None:
    """Every ``value`` with more rows than the limit and its ``rows``, written; None without any.

    ``within`` has at least the rows of ``df`` and is cheap to count: if it has no more rows than
    the limit, neither has any value. Nor has one whose hash falls into a group of values that has
    no more rows: few groups are counted before all values are. ``alike`` is equal where the value
    is, and cheaper to hash.
    """
    limit = hot_rows or HOT_ROWS
    if within is not None:
        total = within.count()
        if total <= limit:
            return None
        groups = GROUPS_PER_VALUE * total // limit
        if groups <= min(total // GROUPS_PER_VALUE, MOST_GROUPS):
            group = F.pmod(F.xxhash64(column if alike is None else alike), F.lit(groups))
            counts = df.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("rows"))
            full = [r["group"] for r in counts.filter(F.col("rows") > limit).collect()]
            if not full:
                return None
            if len(full) <= MOST_LISTED:
                df = df.filter(group.isin(full))
    hot = written(
        df.groupBy(column.alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > limit),
        "hot-values",
    )
    return None if hot.isEmpty() else hot


def is_among(df: DataFrame, column: Column, hot: DataFrame, *, wanted: bool) -> DataFrame:
    """The rows whose value is listed, or those whose value is not."""
    listed = hot.select(F.col("value").alias("__listed"))
    return df.join(listed, column == F.col("__listed"), "left_semi" if wanted else "left_anti")
