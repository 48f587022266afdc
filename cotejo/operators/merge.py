"""Outer merge of two tables on several keys, and derived columns."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.functions.operand import quoted
from cotejo.operators.cross import MATCH, ONLY_A, ONLY_B
from cotejo.operators.outer_join import full_outer
from cotejo.session import setting

logger = logging.getLogger(__name__)

MERGE_STATE = "estado_bttf"  # fixed value: name of the state column of a merge


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all sources, matched by column name; missing columns are NULL."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked


def outer_merge(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    *,
    ordered: bool = False,
    strategy: str = "auto",
    hot_rows: int | None = None,
) -> DataFrame:
    """Full outer merge where NULL keys match each other.

    Columns that both tables have are coalesced, A first, and stand after the state column.
    ``ordered`` sorts the result by the keys, NULLs last; it costs a range shuffle.
    """
    for side, frame in (("A", a), ("B", b)):
        missing = [key for key in keys if key not in frame.columns]
        if missing or not keys:
            raise KeyError(f"merge keys missing in {side}: {missing}")
    left = a.select(
        *[F.col(quoted(name)).alias(f"a.{name}") for name in a.columns], F.lit(True).alias("in.a")
    )
    right = b.select(
        *[F.col(quoted(name)).alias(f"b.{name}") for name in b.columns], F.lit(True).alias("in.b")
    )
    joined = full_outer(
        left,
        right,
        [(f"a.{key}", f"b.{key}") for key in keys],
        null_safe=True,
        strategy=strategy,
        hot_rows=hot_rows,
    )

    in_a, in_b = F.col("`in.a`").isNotNull(), F.col("`in.b`").isNotNull()
    state = F.when(in_a & in_b, MATCH).when(in_a, ONLY_A).otherwise(ONLY_B)
    shared = [name for name in a.columns if name in b.columns and name not in keys]
    columns = {
        key: F.coalesce(F.col(quoted(f"a.{key}")), F.col(quoted(f"b.{key}"))) for key in keys
    }
    for side, frame, suffix in (("a", a, "_x"), ("b", b, "_y")):
        for name in frame.columns:
            if name not in keys:
                column = F.col(quoted(f"{side}.{name}"))
                columns[name + suffix if name in shared else name] = column
    columns[MERGE_STATE] = state
    merged = joined.select(*[column.alias(name) for name, column in columns.items()])
    merged = coalesce_suffixes(merged)
    if ordered:
        merged = merged.orderBy(*[F.col(quoted(key)).asc_nulls_last() for key in keys])
    return merged


def coalesce_suffixes(df: DataFrame) -> DataFrame:
    """Fold each pair ``x_x``/``x_y`` into ``x``: the first non-null of both, put last."""
    folded = {}
    for name in df.columns:
        base = name.removesuffix("_x")
        if base != name and f"{base}_y" in df.columns:
            folded[base] = F.coalesce(F.col(quoted(name)), F.col(quoted(f"{base}_y")))
    dropped = {f"{base}_{side}" for base in folded for side in "xy"}
    kept = [
        folded.pop(name).alias(name) if name in folded else F.col(quoted(name))
        for name in df.columns
        if name not in dropped
    ]
    return df.select(*kept, *[column.alias(base) for base, column in folded.items()])


def derive(df: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Add ``target = SQL expression`` in order; a rule Spark rejects is logged and skipped.

    Rules are resolved with lenient arithmetic, which their plan keeps: a division by zero or a
    text that is no number gives NULL in its row, not the end of the job.
    """
    for target, expression in rules:
        try:
            with setting(df.sparkSession, "spark.sql.ansi.enabled", "false"):
                df = df.withColumn(target, F.expr(expression))
        except (AnalysisException, ParseException) as problem:
            logger.error("rule skipped: %s = %s: %s", target, expression, problem)
    return df
