"""Readers and plain sinks."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.functions.operand import quoted
from cotejo.operators.names import identifier
from cotejo.sources.claims import claim_next


def read_table(spark: SparkSession, name: str, schema: str | None = None) -> DataFrame:
    """A catalog table or view by name; ``schema`` replaces any qualifier in ``name``."""
    return spark.table(f"{schema}.{identifier(name)}" if schema else name)


def read_query(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)


#: Stands for NULL in no file: a reader that knows it tells missing values from empty texts.
NO_TEXT = "\x01"
#: One dialect for reading and writing: quotes are doubled, blanks and line ends belong to values.
CSV_DIALECT = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    *,
    multiline: bool = True,
    null_value: str = NO_TEXT,
) -> DataFrame:
    """CSV with header. Give ``schema`` for large files: types are inferred from whole files, each
    read by one task where ``multiline`` lets quoted values hold line ends.

    Nothing between two commas is NULL, ``""`` is the empty text, and ``null_value`` is NULL too.
    Line ends inside values stay as they are. With a schema, files whose values hold line ends are read by many tasks as well.
    """
    options = {**CSV_DIALECT, "nullValue": null_value, "emptyValue": ""}
    reader = spark.read.options(**options, multiLine=multiline)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    if not multiline:
        return reader.schema(schema).csv(path)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}
    del parsed["header"]
    # a record never starts in the middle of one, so each is parsed by itself
    row = F.from_csv("record", F.lit(wanted.toDDL()), {**parsed, "multiLine": "true"})
    return csv_records(spark, path).select(row.alias("row")).select("row.*")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files but for their headers, as texts, read in byte ranges.

    A line end inside quotes belongs to a value, and whether a line starts inside quotes is told by
    the number of quotes before it, odd or even (a doubled quote changes nothing). Lines are read in
    ranges of any file; quotes are counted per range, the parities of the ranges are added up in
    the order of the file, one row per range, and then each range knows where its records start. A
    record is kept by the range it starts in, whose lines are placed together once; lines that
    carry on a record from an earlier range join it by its number.
    """
    quote = CSV_DIALECT["quote"]
    value = F.col("value")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("line"),  # rises along a range
        value,
        F.pmod(F.length(value) - F.length(F.replace(value, F.lit(quote))), F.lit(2)).alias("odd"),
    )
    before = Window.partitionBy("file", "range").orderBy("line")
    upto = before.rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("inner", F.coalesce(F.sum("odd").over(upto), F.lit(0)) % 2)
    ranges = placed.groupBy("file", "range").agg(
        F.sum("odd").alias("odd"),
        # records that start in the range, if it starts outside of quotes or inside
        F.count_if(F.col("inner") == 0).alias("outside"),
        F.count_if(F.col("inner") == 1).alias("inside"),
    )
    earlier = Window.partitionBy("file").orderBy("range")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    open_at = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
    starts = F.when(F.col("open") == 1, F.col("inside")).otherwise(F.col("outside"))
    ranges = ranges.withColumn("open", open_at).select(
        "file", "range", "open", F.coalesce(F.sum(starts).over(earlier), F.lit(0)).alias("first")
    )
    known = placed.join(ranges, ["file", "range"])
    begins = ((F.col("inner") + F.col("open")) % 2 == 0).cast("int")
    numbered = known.withColumn("begins", begins).withColumn(
        "record", F.col("first") + F.sum("begins").over(before)
    )
    whole = (F.col("begins") == 1) & (F.col("odd") == 0)
    one = numbered.where(whole).select("file", "record", "value")
    parts = F.array_sort(F.collect_list(F.struct("range", "line", "value")))
    many = (
        numbered.where(~whole)
        .groupBy("file", "record")
        .agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    )
    record = F.regexp_replace("value", "\r$", "")
    found = one.unionByName(many).where("record > 1").select(record.alias("record"))
    return found.where("record <> ''")


def read_source(
    spark: SparkSession, *, query: str | None = None, path: str | None = None
) -> DataFrame:
    """A source given by SQL query or by the path of a CSV or parquet file."""
    if query:
        return read_query(spark, query)
    if not path:
        raise ValueError("a source needs a query or a path")
    if path.lower().endswith(".csv"):
        return read_csv(spark, path)
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path!r}")


def write_csv(df: DataFrame, path: str, *, append: bool = False) -> None:
    """CSV with header: the first write replaces, later ones append. Nested values go as JSON."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    columns = [
        F.to_json(F.col(quoted(field.name))).alias(field.name)
        if isinstance(field.dataType, nested)
        else F.col(quoted(field.name))
        for field in df.schema
    ]
    mode = "append" if append else "overwrite"
    written = df.select(*columns).write.mode(mode)
    written.options(**CSV_DIALECT, nullValue="", emptyValue='""').csv(path)


def replace_table(df: DataFrame, table: str) -> int:
    """Put the rows in the place of the table; returns how many it holds.

    They are written under another name first and take the table's place when complete, so rows
    that fail leave the old table as it was.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex[:12]
    fresh, old = f"{table}_new_{mark}", f"{table}_old_{mark}"
    try:
        df.write.format("parquet").saveAsTable(fresh)
        rows = spark.table(fresh).count()
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        raise
    replaced = spark.catalog.tableExists(table)
    if replaced:
        spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
    if replaced:
        spark.sql(f"DROP TABLE {old}")
    return rows


def replace_version(df: DataFrame, view: str) -> int:
    """Put the rows in the place of what the view shows; returns how many there are.

    They are written as a table of their own, a numbered version that never changes, and the view
    is pointed at it in one step: a reader finds the old rows or the new ones, and is never without
    either. The version before stays for readers that have begun with it; older ones are dropped.
    """
    spark = df.sparkSession
    database, _, name = view.replace("`", "").lower().rpartition(".")
    database = database or spark.catalog.currentDatabase()
    if spark.catalog.tableExists(view) and spark.catalog.getTable(view).tableType != "VIEW":
        raise ValueError(f"{view} is a table: versions are shown by a view")
    place = spark.catalog.getDatabase(database).locationUri
    number = claim_next(spark, f"{place}/_versions/{name}", 0)
    fresh = f"{database}.{name}_v{number}"
    try:
        df.write.format("parquet").saveAsTable(fresh)
        rows = spark.table(fresh).count()
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        raise
    spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT * FROM {fresh}")
    listed = spark.sql(f"SHOW TABLES IN {database} LIKE '{name}_v*'").collect()
    found = (re.fullmatch(rf"{re.escape(name)}_v(\d+)", row["tableName"]) for row in listed)
    older = sorted(int(match[1]) for match in found if match and int(match[1]) < number)
    for gone in older[:-1]:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}_v{gone}")
    return rows
