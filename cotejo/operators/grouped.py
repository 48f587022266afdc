"""Distinct groups of a table, optionally aggregated and ordered."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.operand import quoted
from cotejo.operators.names import IDENTIFIER, split_list

ORDER_RULE = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\s+(ASC|DESC|asc|desc)")


def order_columns(rules: str | Sequence[str], allowed: Sequence[str]) -> list[Column]:
    """``name ASC|DESC`` rules as sort columns; NULLs rank above every value."""
    columns = []
    for rule in split_list(rules):
        match = ORDER_RULE.fullmatch(rule)
        if match is None:
            raise ValueError(f"order rule must read 'column ASC' or 'column DESC': {rule!r}")
        name, direction = match.groups()
        if name not in allowed:
            raise ValueError(f"order column {name!r} is neither grouped nor aggregated")
        column = F.col(quoted(name))
        columns.append(
            column.asc_nulls_last() if direction.upper() == "ASC" else column.desc_nulls_first()
        )
    return columns


def grouped(
    df: DataFrame,
    group_by: str | Sequence[str],
    order_by: str | Sequence[str] = (),
    aggs: dict[str, Column] | None = None,
) -> DataFrame:
    """Distinct groups, or one row per group with the named aggregates.

    The group columns end the sort key, so a value many groups share still sorts in many tasks.
    """
    groups = split_list(group_by)
    if not groups:
        raise ValueError("group columns cannot be empty")
    for name in groups:
        if not IDENTIFIER.fullmatch(name):
            raise ValueError(f"not a column name: {name!r}")
    aggs = aggs or {}
    order = order_columns(order_by, [*groups, *aggs])
    names = [quoted(name) for name in groups]
    if aggs:
        result = df.groupBy(*names).agg(*[column.alias(name) for name, column in aggs.items()])
    else:
        result = df.select(*names).distinct()
    return result.orderBy(*order, *names) if order else result
