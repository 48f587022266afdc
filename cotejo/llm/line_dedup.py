"""Dropping lines that many documents share, over levelled sorted runs of line hashes.

Documents come in batches, dealt by a hash of what is counted once, and are read once: their distinct
line hashes are counted by batch and staged, each batch in files of its own. A batch is then
anti-joined with the hashes already settled as frequent and forms a sorted run of level 0. When a
level holds ``fan_in`` runs they are compacted into one run of the next level: counts of equal
hashes are added, and hashes that reach the limit move to a settled run. A last compaction over
all levels makes the settled runs exact: counts add up over runs, and a settled hash needs no more
counting.

Runs are partitions of one table in the shared folder that is bucketed and sorted by hash. So batch
and settled runs, and the runs of a compaction, are merged bucket by bucket without a shuffle. The
driver holds the numbers of the runs only. A run is never changed, so a task that runs again reads
the same rows.

Defined results: a NULL or empty text is one empty line; lines whose key is shorter than
``min_chars`` are never dropped; equal rows count as so many documents; an empty table gives no
rows; long texts are handled like others, a line at a time; columns of the input with the name of a
result column, in any case, are replaced by it, those of any other name stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import (
    SPACE,
    ascii_lower,
    let,
    row_key,
    scratch_folder,
    stored,
    text_of,
    with_columns,
)
from cotejo.session import estimated_bytes

#: Bytes of the input, as Spark estimates it, for a batch and for a bucket of the runs.
BATCH_BYTES = 1 << 40
BUCKET_BYTES = 1 << 28
MOST_BATCHES, MOST_BUCKETS = 64, 20_000
FAN_IN = 4
#: Estimates from here on are none: of rows that no file holds, or of a join.
UNKNOWN = 1 << 50


def line_key(line: Column) -> Column:
    """A line without white space at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _hash_of(key: Column) -> Column:
    return F.struct(
        F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2")
    )


def line_hashes(text: Column, min_chars: int) -> Column:
    """Array of the hashes of all lines, NULL for a line whose key is too short."""

    def hashed(line: Column) -> Column:
        return let(
            line_key(line), lambda key: F.when(F.length(key) >= min_chars, _hash_of(key))
        )

    return F.transform(F.split(text, "\n", -1), hashed)


class LineRuns:
    """Levelled sorted runs of line hashes with the number of documents that hold them."""

    def __init__(
        self, spark: SparkSession, min_docs: int = 10, fan_in: int = FAN_IN, buckets: int = 8
    ) -> None:
        if min_docs < 1 or fan_in < 2:
            raise ValueError("min_docs must be 1 at least, fan_in 2 at least")
        self.spark = spark
        self.min_docs = min_docs
        self.fan_in = fan_in
        self.buckets = buckets
        self.levels: dict[int, list[int]] = {}
        self.settled: list[int] = []
        database = f"line_runs_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch_folder(spark, 'line-runs')}'")
        self.table = f"{database}.runs"
        spark.sql(
            f"CREATE TABLE {self.table} (h1 long, h2 long, n_docs long, run int) USING parquet "
            f"PARTITIONED BY (run) CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {buckets} BUCKETS"
        )
        self._written = 0

    def _number(self) -> int:
        self._written += 1
        return self._written

    def read(self, runs: list[int]) -> DataFrame:
        """The rows of some runs; they come bucket by bucket, whichever runs they are of."""
        return self.spark.table(self.table).where(F.col("run").isin(runs)).drop("run")

    def _write(self, rows: DataFrame) -> None:
        """Rows placed by hash, with the run that each belongs to."""
        writer = rows.select("h1", "h2", "n_docs", "run").write.mode("append").format("parquet")
        buckets = writer.partitionBy("run").bucketBy(self.buckets, "h1", "h2")
        buckets.sortBy("h1", "h2").saveAsTable(self.table)

    def unsettled(self, rows: DataFrame) -> DataFrame:
        if not self.settled:
            return rows
        return rows.join(self.read(self.settled), ["h1", "h2"], "left_anti")

    def stage(self, hashes: DataFrame, batches: int) -> list[int]:
        """Counts the rows ``h`` (a line hash) and ``batch``; each batch becomes a run to be added."""
        first = self._written + 1
        self._written += batches
        counted = (
            hashes.groupBy(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"), "batch")
            .agg(F.count(F.lit(1)).alias("n_docs"))
            .withColumn("run", (F.col("batch") + first).cast("int"))
        )
        self._write(counted.repartition(self.buckets, "h1", "h2"))
        return list(range(first, first + batches))

    def add(self, staged: int) -> None:
        """A batch as a run: without the hashes that are settled already."""
        run = staged
        if self.settled:
            run = self._number()
            rows = self.unsettled(self.read([staged]))
            self._write(rows.withColumn("run", F.lit(run)))
        self.levels.setdefault(0, []).append(run)
        level = 0
        while len(self.levels.get(level, [])) >= self.fan_in:
            self._compact(self.levels.pop(level), level + 1)
            level += 1

    def _merged(self, runs: list[int]) -> DataFrame:
        counts = self.unsettled(self.read(runs)).groupBy("h1", "h2")
        return counts.agg(F.sum("n_docs").alias("n_docs"))

    def _compact(self, runs: list[int], level: int) -> None:
        settled, open_run = self._number(), self._number()
        run = F.when(F.col("n_docs") >= self.min_docs, settled).otherwise(open_run)
        self._write(self._merged(runs).withColumn("run", run))
        self.settled.append(settled)
        self.levels.setdefault(level, []).append(open_run)

    def finish(self) -> DataFrame:
        """Compacts what is left on all levels and gives the frequent hashes, each once."""
        left = [run for runs in self.levels.values() for run in runs]
        if left:
            self.levels.clear()
            settled = self._number()
            frequent = self._merged(left).where(F.col("n_docs") >= self.min_docs)
            self._write(frequent.withColumn("run", F.lit(settled)))
            self.settled.append(settled)
        return self.read(self.settled).select("h1", "h2")


def frequent_lines(
    docs: DataFrame,
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    fan_in: int = FAN_IN,
    once_per: Column | None = None,
    batches: int | None = None,
    size: int | None = None,
) -> DataFrame:
    """Hashes of the lines found in at least ``min_docs`` documents; with ``once_per`` in documents
    of so many different values of it, such as the groups of near copies. ``size``: bytes of the
    documents, where Spark's estimate would not do, as for the rows of a join."""
    size = estimated_bytes(docs) if size is None else size
    if size >= UNKNOWN:
        size = docs.agg(F.sum(F.octet_length(text_of(text_col)).cast("long"))).first()[0] or 0
    if batches is None:
        # more than a level holds, so that later batches meet settled hashes
        batches = min(max(fan_in + 2, size // BATCH_BYTES), MOST_BATCHES)
    buckets = min(max(8, size // BUCKET_BYTES), MOST_BUCKETS)
    text = text_of(text_col)
    hashes = F.explode(F.array_distinct(line_hashes(text, min_chars))).alias("h")
    if once_per is None:
        batch = F.pmod(F.xxhash64(F.lit(3), text), F.lit(batches)).alias("batch")
        lines = docs.select(batch, hashes).where(F.col("h").isNotNull())
    else:
        lines = docs.select(once_per.alias("key"), hashes).where(F.col("h").isNotNull())
        batch = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(batches)).alias("batch")
        lines = lines.distinct().select(batch, "h")
    runs = LineRuns(docs.sparkSession, min_docs, fan_in, int(buckets))
    for staged in runs.stage(lines, int(batches)):
        runs.add(staged)
    return runs.finish()


def drop_lines(
    docs: DataFrame, frequent: DataFrame, text_col: str = "text", min_chars: int = 1
) -> DataFrame:
    """Adds n_lines, n_dropped and ``kept_text``, the text without lines of frequent hashes.

    Only hashes and positions are shuffled to find the lines; texts move once, to the positions.
    Equal texts have equal positions and are looked up once; the positions are written, so that
    Spark can split the texts of a key that many documents share.
    """
    text = text_of(text_col)
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(rows, text.alias("text"), row_key(text).alias("key"))
    found = (
        keyed.select("key", F.posexplode(line_hashes(F.col("text"), min_chars)).alias("pos", "h"))
        .where(F.col("h").isNotNull())
        .select("key", "pos", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
        .join(frequent, ["h1", "h2"])
        .groupBy("key")
        .agg(F.collect_set("pos").alias("drop"))
    )
    joined = keyed.join(stored(found, "line-places"), "key", "left")

    def kept(lines: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        left = F.array_except(places, F.col("drop"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    lines = F.split("text", "\n", -1)
    added = {
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(F.size("drop"), F.lit(0)).cast("long"),
        "kept_text": F.when(F.col("drop").isNull(), F.col("text")).otherwise(let(lines, kept)),
    }
    rest = [c for c in docs.columns if c.lower() not in added]
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in rest],
        *[value.alias(name) for name, value in added.items()],
    )


def line_dedup(
    docs: DataFrame,
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    fan_in: int = FAN_IN,
    once_per: Column | None = None,
    batches: int | None = None,
) -> DataFrame:
    """Counts the lines of all documents in batches, then drops the frequent ones everywhere. With
    ``once_per`` documents of one value of it count once, so that copies alone do not make their
    lines frequent."""
    frequent = frequent_lines(docs, text_col, min_docs, min_chars, fan_in, once_per, batches)
    return drop_lines(docs, frequent, text_col, min_chars)
