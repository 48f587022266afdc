"""Sources, sinks and result tables; written data goes to a scratch folder and is read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.operators.cross import ColumnPair
from cotejo.operators.state import VAULT_SCHEMA, aligned
from cotejo.plans.outer_merge import run_outer_merge
from cotejo.plans.reconcile import run_reconcile
from cotejo.plans.worktable import run_worktable
from cotejo.sources import history
from cotejo.sources.tables import (
    read_csv,
    read_query,
    read_source,
    read_table,
    replace_table,
    replace_version,
    write_csv,
)
from workloads.base import Tables, scratch_database, scratch_path, workload
from workloads.inputs import DAYS_CROSSED, daily_orders, daily_shipments

FIRST, SECOND = datetime(2024, 1, 1), datetime(2024, 1, 2)
_DAY = "yyyy-MM-dd"


@workload("S1_table_scan", "SELECT * FROM orders")
def table_scan(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("scanned_orders")
    return read_table(t.spark, "scanned_orders")


@workload(
    "S2_query_source",
    "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus",
)
def query_source(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("queried_orders")
    return read_query(
        t.spark,
        "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM queried_orders GROUP BY 1",
    )


@workload("S3_csv_source", "SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_source(t: Tables) -> DataFrame:
    path = f"{scratch_path(t.spark)}/part.csv"
    write_csv(t.part, path)
    return read_source(t.spark, path=path)


@workload(
    "S4_csv_sink",
    """SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer""",
)
def csv_sink(t: Tables) -> DataFrame:
    """The first write replaces what is there, the second appends."""
    path = f"{scratch_path(t.spark)}/parties.csv"
    customers = t.customer.select(
        F.col("c_custkey").alias("s_suppkey"),
        F.col("c_name").alias("s_name"),
        F.col("c_nationkey").alias("s_nationkey"),
        F.col("c_acctbal").alias("s_acctbal"),
    )
    write_csv(customers, path)
    write_csv(t.supplier, path)
    write_csv(customers, path, append=True)
    return read_csv(t.spark, path, t.supplier.schema)


_TEXTS_SQL = """SELECT 'documents' AS kind, doc_id AS id, 0 AS part, text FROM documents
UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations
UNION ALL SELECT 'pages', page_id, 0, html FROM pages"""


def _texts(t: Tables) -> DataFrame:
    """All long texts, with quotes, line ends, blanks at their ends and markup."""

    def named(df: DataFrame, kind: str, key: str, text: str, part: str | None = None) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"),
            F.col(key).alias("id"),
            (F.col(part) if part else F.lit(0)).cast("int").alias("part"),
            F.col(text).alias("text"),
        )

    return (
        named(t.documents, "documents", "doc_id", "text")
        .unionByName(named(t.conversations, "conversations", "conv_id", "text", "turn"))
        .unionByName(named(t.pages, "pages", "page_id", "html"))
    )


@workload("S3_csv_source_texts", _TEXTS_SQL)
def csv_source_texts(t: Tables) -> DataFrame:
    """Types are inferred from the file."""
    path = f"{scratch_path(t.spark)}/texts.csv"
    write_csv(_texts(t), path)
    return read_source(t.spark, path=path).withColumn("id", F.col("id").cast("bigint"))


@workload("S4_csv_sink_texts", _TEXTS_SQL)
def csv_sink_texts(t: Tables) -> DataFrame:
    """Replaced once, then appended to, and read with the schema written."""
    path = f"{scratch_path(t.spark)}/texts.csv"
    texts = _texts(t)
    write_csv(texts, path)
    write_csv(texts.filter("kind = 'documents'"), path)
    write_csv(texts.filter("kind <> 'documents'"), path, append=True)
    return read_csv(t.spark, path, texts.schema)


def _two_runs(t: Tables) -> tuple[str, list]:
    table = f"{scratch_database(t.spark)}.runs"
    a, b = daily_orders(t), daily_shipments(t)
    runs = [
        run_reconcile(
            a, b, "o_orderdate", "l_shipdate", [ColumnPair("placed", "shipped", method)],
            target_table=table, created_at=at, source="batch", job_id=job, analysis_name=name,
        )
        for method, at, job, name in (
            ("DIFERENCIA", FIRST, "job-1", None),
            ("math_ratio", SECOND, None, "ratios"),
        )
    ]
    return table, runs


@workload(
    "S5_history_append",
    f"""WITH {DAYS_CROSSED.lstrip()}
SELECT llave_cruce, estado_cruce, run_id, strftime(created_at, '%Y-%m-%d') AS day, job_id, analysis_name, source,
       CASE WHEN run_id = 1 THEN CAST(shipped - placed AS DOUBLE) END AS "0_diferencia",
       CASE WHEN run_id = 2 AND shipped <> 0 THEN placed / shipped END AS "0_math_ratio"
FROM j, (VALUES (1, TIMESTAMP '2024-01-01', 'job-1', NULL, 'batch'),
                (2, TIMESTAMP '2024-01-02', NULL, 'ratios', 'batch')) AS r(run_id, created_at, job_id, analysis_name, source)""",
)
def history_append(t: Tables) -> DataFrame:
    """Two runs in one table; the second brings new columns, older rows read NULL there."""
    table, _ = _two_runs(t)
    return t.spark.table(table).select(
        "llave_cruce",
        "estado_cruce",
        F.col("run_id").cast("int").alias("run_id"),
        F.date_format("created_at", _DAY).alias("day"),
        "job_id",
        "analysis_name",
        "source",
        "`0_diferencia`",
        "`0_math_ratio`",
    )


@workload(
    "S6_schema_evolution",
    """SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderstatus, 1 AS run_id FROM orders
UNION ALL SELECT o_orderkey, NULL, o_orderstatus, 2 FROM orders""",
)
def schema_evolution(t: Tables) -> DataFrame:
    table = f"{scratch_database(t.spark)}.evolving"
    history.append(t.orders.select("o_orderkey", "o_totalprice", F.lit(1).alias("run_id")), table)
    wider = t.orders.select("o_orderkey", "o_orderstatus", F.lit(2).alias("run_id"))
    changed = history.append(wider, table), history.append(wider.limit(0), table)
    if changed != (True, False):
        raise AssertionError(f"schema changes not told: {changed}")
    return t.spark.table(table).select("o_orderkey", "o_totalprice", "o_orderstatus", "run_id")


@workload(
    "S6_run_without_rows",
    "SELECT o_orderkey, 1 AS run_id, 2 AS columns, true AS refused FROM orders",
)
def run_without_rows(t: Tables) -> DataFrame:
    """A run without rows leaves the table as it is, and so does one that would lose values."""
    table = f"{scratch_database(t.spark)}.unchanged"
    history.append(t.orders.select("o_orderkey", F.lit(1).alias("run_id")), table)
    none = t.orders.limit(0)
    run_reconcile(
        none, none, "o_orderkey", "o_orderkey",
        [ColumnPair("o_totalprice", "o_totalprice", "DIFERENCIA")],
        target_table=table, created_at=FIRST, source="batch",
    )
    try:
        history.append(
            t.orders.select((F.col("o_totalprice") / 7).alias("o_orderkey"), F.lit(2).alias("run_id")),
            table,
        )
        refused = False
    except TypeError:
        refused = True
    rows = t.spark.table(table)
    return rows.select(
        "o_orderkey", "run_id", F.lit(len(rows.columns)).alias("columns"), F.lit(refused).alias("refused")
    )


@workload(
    "S8_next_run_id",
    """SELECT 1 AS absent, 3 AS after_two,
       (SELECT CAST(max(extract(year FROM o_orderdate)) AS INTEGER) + 1 FROM orders) AS after_years""",
)
def run_numbers(t: Tables) -> DataFrame:
    """After two runs, without a table, and in a table whose runs are the years of the orders."""
    table, _ = _two_runs(t)
    absent = history.next_run_id(t.spark, f"{table}_absent")
    after = history.next_run_id(t.spark, table)
    years = f"{table}_years"
    history.append(t.orders.select("o_orderkey", F.year("o_orderdate").alias("run_id")), years)
    return t.spark.range(1).select(
        F.lit(absent).alias("absent"),
        F.lit(after).alias("after_two"),
        F.lit(history.next_run_id(t.spark, years)).alias("after_years"),
    )


@workload(
    "S9_run_stamp",
    """SELECT o_orderkey, 7 AS run_id, '2024-01-01' AS created_at, '2024-01-01' AS "timestamp", 'j' AS job_id, 'batch' AS source
FROM orders""",
)
def run_stamp(t: Tables) -> DataFrame:
    """An id that is not given adds no column."""
    stamped = history.stamp(t.orders.select("o_orderkey"), 7, FIRST, source="batch", job_id="j")
    days = {name: F.date_format(name, _DAY) for name in ("created_at", "timestamp")}
    return stamped.withColumns(days).withColumn("run_id", F.col("run_id").cast("int"))


@workload(
    "S10_metadata_last",
    """SELECT l_orderkey, l_quantity, 'created_at,source' AS closing, '2024-01-01' AS created_at, l_returnflag AS source
FROM lineitem""",
)
def metadata_order(t: Tables) -> DataFrame:
    mixed = t.lineitem.select(
        F.col("l_returnflag").alias("source"),
        "l_orderkey",
        F.lit("2024-01-01").alias("created_at"),
        "l_quantity",
    )
    ordered = history.metadata_last(mixed)
    closing = ",".join(ordered.columns[2:])
    return ordered.select(*ordered.columns[:2], F.lit(closing).alias("closing"), *ordered.columns[2:])


@workload(
    "S11_replace_version",
    "SELECT s_suppkey, s_acctbal, (SELECT count(*) FROM supplier) AS rows FROM supplier",
)
def replaced_version(t: Tables) -> DataFrame:
    """The view shows the second version; the first one was another table."""
    view = f"{scratch_database(t.spark)}.shown"
    replace_version(t.customer.select("c_custkey"), view)
    rows = replace_version(t.supplier.select("s_suppkey", "s_acctbal"), view)
    return t.spark.table(view).withColumn("rows", F.lit(rows))


@workload("S11_replace_table", "SELECT s_suppkey, s_acctbal, (SELECT count(*) FROM supplier) AS rows FROM supplier")
def replaced_table(t: Tables) -> DataFrame:
    table = f"{scratch_database(t.spark)}.replaced"
    replace_table(t.customer.select("c_custkey"), table)
    rows = replace_table(t.supplier.select("s_suppkey", "s_acctbal"), table)
    return t.spark.table(table).withColumn("rows", F.lit(rows).cast("long"))


@workload(
    "S12_aligned_state_tables",
    """SELECT CAST(o_orderkey AS VARCHAR) AS entidad_interna_id, CAST(NULL AS VARCHAR) AS llave_humana_completa,
       'estado' AS propiedad_origen, CAST(NULL AS VARCHAR) AS valor_original, o_orderstatus AS valor_limpio,
       '' AS firma_auditoria, CAST(NULL AS VARCHAR) AS tipo_dato_generico, CAST(NULL AS VARCHAR) AS tabla_origen,
       'carga_masiva' AS origen_dato, CAST(NULL AS VARCHAR) AS creado_por, 'VIGENTE' AS estado,
       CAST(NULL AS VARCHAR) AS job_id
FROM orders""",
)
def aligned_vault(t: Tables) -> DataFrame:
    """An older vault without the versioning columns gets them with their defaults."""
    old = t.orders.select(
        F.col("o_orderkey").alias("entidad_interna_id"),
        F.lit("estado").alias("propiedad_origen"),
        F.col("o_orderstatus").alias("valor_limpio"),
    )
    return aligned(old, VAULT_SCHEMA).drop("desde", "hasta")


@workload(
    "R1_reconcile_job_summary",
    f"""WITH {DAYS_CROSSED.lstrip()}, s AS (
  SELECT count(*) AS n, count(*) FILTER (estado_cruce = 'Match') AS m,
         count(*) FILTER (estado_cruce = 'Only A') AS x, count(*) FILTER (estado_cruce = 'Only B') AS y FROM j)
SELECT run_id, n AS "totalRows", m AS matches, x AS "onlyA", y AS "onlyB", false AS "hasDuplicates"
FROM s, (VALUES (1), (2)) AS r(run_id)""",
)
def run_summaries(t: Tables) -> DataFrame:
    _, runs = _two_runs(t)
    first, second = (run.summary.withColumn("run_id", F.lit(run.run_id)) for run in runs)
    return first.unionByName(second)


@workload(
    "R2_outer_merge_job_append",
    """SELECT coalesce(c_custkey, s_suppkey) AS id, run_id,
       CASE WHEN c_custkey IS NULL THEN 'Only B' WHEN s_suppkey IS NULL THEN 'Only A' ELSE 'Match' END AS estado_bttf,
       coalesce(c_name, s_name) AS name
FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey, (VALUES ('one'), ('two')) AS r(run_id)""",
)
def merge_appends(t: Tables) -> DataFrame:
    table = f"{scratch_database(t.spark)}.merged"
    a = t.customer.selectExpr("c_custkey AS id", "c_name AS name")
    b = t.supplier.selectExpr("s_suppkey AS id", "s_name AS name")
    for run_id, at in (("one", FIRST), ("two", SECOND)):
        run_outer_merge([a], [b], ["id"], run_id=run_id, created_at=at, target_table=table)
    return t.spark.table(table).select("id", "run_id", "estado_bttf", "name")


@workload(
    "R3_worktable_job",
    """SELECT DISTINCT l_returnflag, l_linestatus, r.run_id, 'w' AS job_id, 'worktable' AS source
FROM lineitem, (VALUES (1), (2)) AS r(run_id)""",
)
def worktable(t: Tables) -> DataFrame:
    table = f"{scratch_database(t.spark)}.worktable"
    for at in (FIRST, SECOND):
        run_worktable(
            t.lineitem, "l_returnflag, l_linestatus", "l_linestatus DESC, l_returnflag ASC",
            target_table=table, created_at=at, job_id="w",
        )
    return t.spark.table(table).select(
        "l_returnflag", "l_linestatus", F.col("run_id").cast("int").alias("run_id"), "job_id", "source"
    )
