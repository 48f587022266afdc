"""Full outer equi-join that keeps hot keys out of single tasks.

Spark neither broadcasts nor splits skewed partitions of a full outer join, so one key
holding a large share of the rows would end in one task. Three plans, same rows:

``full``    one shuffled full outer join;
``split``   left outer join plus the unmatched rest, so that a side below the broadcast
            limit is broadcast and the large side is not shuffled at all;
``grid``    one shuffled full outer join on the key and the cell of a grid. Rows of a hot key
            are dealt over their side's parts and repeated over the other side's; what finds
            no partner in its cell is dropped where the key matches as a whole.

``auto`` takes ``split`` for a side below Spark's broadcast limit and decides between the others
by the exact number of rows per key. NULL keys, which match nothing, are dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.functions.operand import quoted
from cotejo.session import conf_bytes, estimated_bytes, written

HOT_ROWS = 1_000_000  # rows of one key that a single task may hold
HOT_PAIRS = 100_000_000  # joined rows of one key that a single task may produce
SPREAD = 1 << 20  # salts of rows whose key is NULL
CELL_ROWS = 256  # rows of a side that a part of a hot key has at least, beyond the first parts:
FIRST_PARTS = 8  # smaller parts would only repeat the other side's rows more often
MOST_TASKS = 20_000  # of a join that makes very many rows

Keys = Sequence[tuple[str, str]]


def full_outer(
    a: DataFrame,
    b: DataFrame,
    on: Keys,
    *,
    null_safe: bool = False,
    strategy: str = "auto",
    hot_rows: int | None = None,
) -> DataFrame:
    """All rows of ``a`` and ``b``, joined where the keys are equal.

    Column names of the two sides must differ. ``null_safe`` lets NULL keys match each other.
    ``hot_rows`` forces the count of rows per key and sets from which count a key is hot.
    """
    if strategy not in ("auto", "full", "split"):
        raise ValueError(f"unknown strategy: {strategy!r}")
    if strategy == "split":
        return _broadcast_right(a, b, on, null_safe)
    if strategy == "full":
        return _shuffled(a, b, on, null_safe)
    if hot_rows is None:
        small = conf_bytes(a.sparkSession, "spark.sql.autoBroadcastJoinThreshold", "10MB")
        if estimated_bytes(b) <= small:
            return _broadcast_right(a, b, on, null_safe)
        if estimated_bytes(a) <= small:
            mirrored = _broadcast_right(b, a, [(kb, ka) for ka, kb in on], null_safe)
            return mirrored.select(*_columns(a), *_columns(b))
    hot = hot_keys(a, b, on, null_safe, hot_rows or HOT_ROWS)
    if hot is None:
        return _shuffled(a, b, on, null_safe)
    return _on_grid(a, b, on, null_safe, hot)


def key_counts(a: DataFrame, b: DataFrame, on: Keys) -> DataFrame:
    """One row per key with its row counts on both sides, from one pass over the key columns."""
    left = a.select(
        *[F.col(quoted(ka)).alias(f"k{i}") for i, (ka, _) in enumerate(on)],
        F.lit(1).alias("in_a"),
        F.lit(0).alias("in_b"),
    )
    right = b.select(
        *[F.col(quoted(kb)).alias(f"k{i}") for i, (_, kb) in enumerate(on)],
        F.lit(0).alias("in_a"),
        F.lit(1).alias("in_b"),
    )
    return (
        left.unionByName(right)
        .groupBy(*[f"k{i}" for i in range(len(on))])
        .agg(F.sum("in_a").alias("rows_a"), F.sum("in_b").alias("rows_b"))
    )


def hot_keys(
    a: DataFrame, b: DataFrame, on: Keys, null_safe: bool, hot_rows: int
) -> DataFrame | None:
    """Every key above a limit with its grid, as a small written table; None if there is none.

    ``parts_a`` and ``parts_b`` are the numbers of parts its rows are dealt over: a row is repeated
    once per part of the other side, so a low limit makes more keys hot and not their parts tiny.
    """
    rows_a, rows_b = F.col("rows_a"), F.col("rows_b")
    pairs = rows_a.cast("double") * rows_b
    names = [f"k{i}" for i in range(len(on))]
    joinable = F.lit(True) if null_safe else _all(F.col(name).isNotNull() for name in names)

    def dealt(rows: Column) -> Column:
        enough = F.greatest(F.ceil(rows / CELL_ROWS), F.lit(FIRST_PARTS))
        return F.greatest(F.least(F.ceil(rows / hot_rows), enough), F.lit(1))

    parts_b = dealt(rows_b)
    parts_a = F.greatest(dealt(rows_a), F.ceil(pairs / (F.lit(float(HOT_PAIRS)) * parts_b)))
    hot = written(
        key_counts(a, b, on)
        .filter((F.greatest("rows_a", "rows_b") > hot_rows) | (pairs > HOT_PAIRS))
        .select(
            *[F.col(name).alias(f"__{name}") for name in names],
            parts_a.cast("long").alias("__parts_a"),
            parts_b.cast("long").alias("__parts_b"),
            (joinable & (rows_a > 0) & (rows_b > 0)).alias("__matched"),
            F.when(joinable, pairs).otherwise(F.lit(0.0)).alias("__pairs"),
        ),
        "hot-keys",
    )
    return None if hot.isEmpty() else hot


def _all(tests) -> Column:
    return reduce(lambda one, other: one & other, tests)


def _columns(df: DataFrame) -> list[Column]:
    return [F.col(quoted(name)) for name in df.columns]


def _nulls(df: DataFrame) -> list[Column]:
    return [F.lit(None).cast(field.dataType).alias(field.name) for field in df.schema]


def _equal(on: Keys, null_safe: bool) -> Column:
    pairs = [(F.col(quoted(ka)), F.col(quoted(kb))) for ka, kb in on]
    return _all(x.eqNullSafe(y) if null_safe else x == y for x, y in pairs)


def _salt(df: DataFrame) -> Column:
    """A number by which rows are dealt: the same when a task runs again, and different for
    copies of a row that come from different tasks."""
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    return F.xxhash64(F.spark_partition_id(), *[F.col(quoted(name)) for name in plain])


def _no_key(keys: Sequence[str]) -> Column:
    return ~_all(F.col(quoted(key)).isNotNull() for key in keys)


def _shuffled(a: DataFrame, b: DataFrame, on: Keys, null_safe: bool) -> DataFrame:
    if null_safe:
        return a.join(b, _equal(on, null_safe), "full_outer")

    def dealt(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        part = F.when(_no_key(keys), F.pmod(_salt(df), F.lit(SPREAD)))
        return df.withColumn(name, F.coalesce(part, F.lit(0).cast("long")))

    left = dealt(a, [ka for ka, _ in on], "__part_a")
    right = dealt(b, [kb for _, kb in on], "__part_b")
    same = _equal(on, null_safe) & (F.col("__part_a") == F.col("__part_b"))
    return left.join(right, same, "full_outer").select(*_columns(a), *_columns(b))


def _broadcast_right(a: DataFrame, b: DataFrame, on: Keys, null_safe: bool) -> DataFrame:
    """``a`` stays in place when ``b`` is below Spark's own broadcast limit.

    The keys of ``b`` that ``a`` hits are no more than ``b`` has, so they are as small.
    """
    spark = a.sparkSession
    limit = conf_bytes(spark, "spark.sql.autoBroadcastJoinThreshold", "10MB")
    share = F.broadcast if estimated_bytes(b) <= limit else (lambda side: side)
    condition = _equal(on, null_safe)
    keys_a = a.select(*[F.col(quoted(ka)) for ka, _ in on])
    keys_b = b.select(*[F.col(quoted(kb)) for _, kb in on])
    matched = a.join(share(b), condition, "left_outer")
    hits = keys_a.join(share(keys_b), condition, "left_semi").distinct()
    rest = b.join(share(hits), condition, "left_anti")
    return matched.unionByName(rest.select(*_nulls(a), *_columns(b)))


def _on_grid(
    a: DataFrame, b: DataFrame, on: Keys, null_safe: bool, hot: DataFrame
) -> DataFrame:
    def tagged(df: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
        """Rows with their cell, ``__own_part`` and ``__own_cell``, once per cell."""
        listed = _all(
            F.col(quoted(key)).eqNullSafe(F.col(f"__k{i}")) for i, key in enumerate(keys)
        )
        parts = F.col(f"__parts_{own}")
        lone = F.lit(False) if null_safe else _no_key(keys)
        part = (
            F.when(parts.isNotNull(), F.pmod(_salt(df), parts))
            .when(lone, F.pmod(_salt(df), F.lit(SPREAD)))
            .otherwise(F.lit(0).cast("long"))
        )
        zero = F.array(F.lit(0).cast("long"))
        cells = F.when(
            F.col("__matched"), F.sequence(F.lit(0).cast("long"), F.col(f"__parts_{other}") - 1)
        )
        return df.join(hot, listed, "left").select(
            *_columns(df),
            part.alias(f"__part_{own}"),
            F.explode(F.coalesce(cells, zero)).alias(f"__cell_{own}"),
            F.coalesce("__matched", F.lit(False)).alias(f"__matched_{own}"),
        )

    left = tagged(a, [ka for ka, _ in on], "a", "b")
    right = tagged(b, [kb for _, kb in on], "b", "a")
    pairs = hot.agg(F.sum("__pairs")).first()[0]
    if pairs > HOT_PAIRS:
        # few bytes are shuffled for what comes out, so Spark would join them in few tasks
        tasks = max(4 * a.sparkSession.sparkContext.defaultParallelism, ceil(pairs / HOT_PAIRS))
        tasks = min(tasks, MOST_TASKS)
        left = left.repartition(tasks, *[quoted(ka) for ka, _ in on], "__part_a", "__cell_a")
        right = right.repartition(tasks, *[quoted(kb) for _, kb in on], "__cell_b", "__part_b")
    same = (
        _equal(on, null_safe)
        & (F.col("__part_a") == F.col("__cell_b"))
        & (F.col("__cell_a") == F.col("__part_b"))
    )
    alone = F.col("__matched_a").isNull() | F.col("__matched_b").isNull()
    matched = F.coalesce("__matched_a", "__matched_b")
    joined = left.join(right, same, "full_outer")
    return joined.filter(~(alone & matched)).select(*_columns(a), *_columns(b))
