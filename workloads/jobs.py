"""Refine, edit and materialize jobs end to end."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.functions.identity import with_entity_id
from cotejo.operators.pivot import wide_entities
from cotejo.operators.state import INVENTORY_SCHEMA, VAULT_SCHEMA, empty
from cotejo.plans.edits import EditBatch, apply_edits, run_edits
from cotejo.plans.materialize import run_materialize
from cotejo.plans.refine import refine, run_refine
from cotejo.sources.config import ConfigRow, load_config
from cotejo.sources.vault_store import VaultStore
from workloads.base import Tables, scratch_database, scratch_path, workload
from workloads.changes import (
    CUSTOMER_CONFIG,
    FIRST,
    SECOND,
    SNAPSHOTS,
    VAULT_COLUMNS,
    VAULT_SQL,
    config_table,
    first_customers,
    first_store,
    second_customers,
    second_run,
    with_days,
)
from workloads.transforms import uuid5_sql

THIRD = datetime(2024, 1, 3)


def stored_runs(t: Tables) -> tuple[VaultStore, list]:
    store = VaultStore(t.spark, f"{scratch_path(t.spark)}/store")
    config = config_table(t, "clientes", CUSTOMER_CONFIG)
    runs = [
        run_refine(store, source, config, source_table="clientes", job_id=job, at=at)
        for source, job, at in (
            (first_customers(t), "job-1", FIRST),
            (second_customers(t), "job-2", SECOND),
        )
    ]
    return store, runs


@workload("R9_refine_job", f"WITH {VAULT_SQL.lstrip()} SELECT {VAULT_COLUMNS} FROM vault")
def refine_job(t: Tables) -> DataFrame:
    store, _ = stored_runs(t)
    return with_days(store.vault(), "desde", "hasta")


_SUMMARY = f"""WITH {VAULT_SQL.lstrip()}, n AS (
  SELECT (SELECT count(*) FROM customer) AS total, (SELECT count(*) FROM s1) AS n1, (SELECT count(*) FROM s2) AS n2,
         (SELECT count(*) FROM s1 WHERE c_custkey NOT IN (SELECT c_custkey FROM s2)) AS gone,
         (SELECT count(*) FROM both_runs WHERE k1 IS NULL) AS inserted,
         (SELECT count(*) FROM both_runs WHERE l1 <> l2) AS updated,
         (SELECT count(*) FROM both_runs WHERE l1 = l2) AS same,
         (SELECT count(*) FROM both_runs WHERE k2 IS NULL) AS removed)"""
_SECOND_SUMMARY = """SELECT 2 AS run, n2 AS filas_procesadas, 0 AS filas_omitidas, inserted AS registros_insertados,
       updated AS registros_actualizados, same AS registros_sin_cambio, removed AS registros_eliminados,
       gone AS entidades_inactivadas, gone AS recien_inactivadas, 0 AS errores FROM n"""


@workload(
    "A10_refine_counters",
    f"""{_SUMMARY}
SELECT 1 AS run, n1 AS filas_procesadas, total - n1 AS filas_omitidas, 4 * n1 AS registros_insertados,
       0 AS registros_actualizados, 0 AS registros_sin_cambio, 0 AS registros_eliminados,
       0 AS entidades_inactivadas, 0 AS recien_inactivadas, 0 AS errores FROM n
UNION ALL {_SECOND_SUMMARY}""",
)
def counters(t: Tables) -> DataFrame:
    _, runs = stored_runs(t)
    summaries = [run.summary for run in runs]
    first, second = (df.select(F.lit(i).alias("run"), "*") for i, df in enumerate(summaries, 1))
    return first.unionByName(second)


@workload("R9_refine_plan_summary", f"{_SUMMARY} {_SECOND_SUMMARY}")
def refine_summary(t: Tables) -> DataFrame:
    """The counters as part of the lazy plan, before anything of the run is written."""
    return second_run(t).summary().select(F.lit(2).alias("run"), "*")


@workload(
    "R12_row_errors",
    """SELECT CAST(o_orderkey AS VARCHAR) AS llave_humana_completa, 'internal_id must not be empty' AS error,
       o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'""",
)
def row_errors(t: Tables) -> DataFrame:
    """Orders still open have no closing code: they fail, the others go on."""
    return _failing(t).errors.select("llave_humana_completa", "error", "o_orderkey", "o_custkey")


@workload(
    "R12_error_run_counters",
    """SELECT count(*) AS filas_procesadas, 2 * count(*) FILTER (o_orderstatus <> 'P') AS registros_insertados,
       count(*) FILTER (o_orderstatus = 'P') AS errores FROM orders""",
)
def error_counters(t: Tables) -> DataFrame:
    return _failing(t).summary().select("filas_procesadas", "registros_insertados", "errores")


@workload(
    "R12_failed_run_counters",
    """SELECT i AS run, CASE i WHEN 1 THEN n ELSE 0 END AS filas_procesadas, CASE i WHEN 1 THEN n ELSE 0 END AS registros_insertados,
       CASE i WHEN 1 THEN 0 ELSE 1 END AS errores, CASE i WHEN 1 THEN NULL ELSE 'job-2' END AS listed, 1 AS version
FROM (SELECT count(*) AS n FROM nation), (SELECT unnest([1, 2]) AS i)""",
)
def failed_run_counters(t: Tables) -> DataFrame:
    """A run without configuration fails as a whole: its summary says so, and nothing is committed."""
    store = VaultStore(t.spark, f"{scratch_path(t.spark)}/store")
    config = config_table(t, "paises", [ConfigRow("n_nationkey", es_llave=True, guardar=False), ConfigRow("n_name")])
    runs = [
        run_refine(
            store, t.nation, config, source_table=source, job_id=job, at=at, on_failure="summary"
        )
        for source, job, at in (("paises", "job-1", FIRST), ("unknown", "job-2", SECOND))
    ]
    listed = store.failures().select(F.lit(2).alias("run"), F.col("job_id").alias("listed"))
    names = ("filas_procesadas", "registros_insertados", "errores")
    parts = [run.summary.select(F.lit(i).alias("run"), *names) for i, run in enumerate(runs, 1)]
    rows = parts[0].unionByName(parts[1]).join(listed, "run", "left")
    return rows.withColumn("version", F.lit(store.version()))


def _failing(t: Tables):
    code = F.when(F.col("o_orderstatus") == "P", F.lit("  ")).otherwise(F.col("o_orderstatus"))
    config = [
        ConfigRow("o_orderkey", es_llave=True, guardar=False),
        ConfigRow("code", "internal_id"),
        ConfigRow("o_totalprice", "moneda"),
    ]
    return refine(
        t.orders.withColumn("code", code),
        config,
        empty(t.spark, VAULT_SCHEMA),
        empty(t.spark, INVENTORY_SCHEMA),
        source_table="pedidos",
        job_id="job-1",
        at=FIRST,
    )


# --- manual edits ---


def order_edits(t: Tables) -> DataFrame:
    """One edit per order: closed ones set the segment, others the balance, open ones nothing known."""
    status = F.col("o_orderstatus")
    orders = with_entity_id(t.orders, F.col("o_custkey").cast("string"), "entidad_interna_id")
    return orders.select(
        F.col("o_orderkey").alias("seq"),
        F.lit("clientes").alias("source_table"),
        "entidad_interna_id",
        F.when(status == "F", "c_mktsegment")
        .when(status == "O", "c_acctbal")
        .otherwise("o_comment")
        .alias("propiedad"),
        F.when(status == "F", F.col("o_orderpriority"))
        .otherwise(F.concat(F.lit("$ "), F.col("o_totalprice").cast("string")))
        .alias("nuevo_valor"),
        F.concat(F.lit(" clerk"), F.col("o_orderkey"), F.lit("@example.org")).alias("usuario_email"),
    )


def edited(t: Tables) -> EditBatch:
    store = first_store(t)
    return apply_edits(
        order_edits(t),
        CUSTOMER_CONFIG,
        store.current(1),
        store.inventory(1),
        source_table="clientes",
        job_id="job-3",
        at=THIRD,
        order_by=["seq"],
    )


EDITS_SQL = f"""{SNAPSHOTS},
  edits AS (SELECT CAST(o_custkey AS VARCHAR) AS k, o_orderkey AS seq,
                   CASE o_orderstatus WHEN 'F' THEN 'c_mktsegment' WHEN 'O' THEN 'c_acctbal' ELSE 'o_comment' END AS prop,
                   CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '$ ' || CAST(o_totalprice AS VARCHAR) END AS original,
                   CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE CAST(o_totalprice AS VARCHAR) END AS limpio,
                   'clerk' || CAST(o_orderkey AS VARCHAR) || '@example.org' AS email,
                   c_custkey IS NOT NULL AS known
            FROM orders LEFT JOIN s1 ON c_custkey = o_custkey),
  records AS (SELECT k, prop, original, limpio, -1 AS seq, CAST(NULL AS VARCHAR) AS email FROM kv1
              UNION ALL SELECT k, prop, original, limpio, seq, email FROM edits WHERE known AND prop <> 'o_comment'),
  c AS (SELECT *, lag(limpio) OVER (PARTITION BY k, prop ORDER BY seq) AS before FROM records),
  changed AS (SELECT * FROM c WHERE seq = -1 OR before IS DISTINCT FROM limpio),
  chain AS (SELECT *, lead(limpio) OVER (PARTITION BY k, prop ORDER BY seq) IS NOT NULL AS followed FROM changed),
  vault AS (SELECT *, CASE WHEN followed THEN 'HISTORICO' ELSE 'VIGENTE' END AS estado,
                   CASE WHEN seq = -1 THEN 'carga_masiva' ELSE 'edicion_manual' END AS origen_dato,
                   CASE WHEN seq = -1 THEN '2024-01-01' ELSE '2024-01-03' END AS desde,
                   CASE WHEN followed THEN '2024-01-03' END AS hasta,
                   CASE WHEN seq = -1 AND NOT followed THEN 'job-1' ELSE 'job-3' END AS job_id FROM chain)"""
_EDITED_VAULT = f"""WITH {EDITS_SQL.lstrip()}
SELECT k AS llave_humana_completa, prop AS propiedad_origen, original AS valor_original, limpio AS valor_limpio,
       origen_dato, email AS creado_por, estado, job_id, desde, hasta FROM vault"""
_EDITED_COLUMNS = (
    "llave_humana_completa",
    "propiedad_origen",
    "valor_original",
    "valor_limpio",
    "origen_dato",
    "creado_por",
    "estado",
    "job_id",
    "desde",
    "hasta",
)


@workload("R11_edit_batch", _EDITED_VAULT)
def edit_batch(t: Tables) -> DataFrame:
    return with_days(edited(t).changes, "desde", "hasta").select(*_EDITED_COLUMNS)


@workload("R11_edit_job", _EDITED_VAULT)
def edit_job(t: Tables) -> DataFrame:
    """The same edits through the stored vault."""
    store = first_store(t)
    run_edits(
        store,
        order_edits(t),
        config_table(t, "clientes", CUSTOMER_CONFIG),
        source_table="clientes",
        job_id="job-3",
        at=THIRD,
        order_by=["seq"],
    )
    return with_days(store.vault(), "desde", "hasta").select(*_EDITED_COLUMNS)


@workload(
    "R11_rejected_edits",
    f"""WITH {EDITS_SQL.lstrip()}
SELECT {uuid5_sql("k")} AS entidad_interna_id, prop AS propiedad, original AS nuevo_valor, email AS usuario_email,
       CASE WHEN prop = 'o_comment' THEN 'property not configured' ELSE 'entity not in the inventory' END AS error
FROM edits WHERE prop = 'o_comment' OR NOT known""",
)
def rejected_edits(t: Tables) -> DataFrame:
    return edited(t).errors.drop("source_table")


@workload(
    "R11_edit_counters",
    f"""WITH {EDITS_SQL.lstrip()}
SELECT 0 AS registros_insertados, (SELECT count(*) FROM changed WHERE seq >= 0) AS registros_actualizados,
       (SELECT count(*) FROM records WHERE seq >= 0) - (SELECT count(*) FROM changed WHERE seq >= 0) AS registros_sin_cambio,
       (SELECT count(*) FROM edits WHERE prop = 'o_comment' OR NOT known) AS errores""",
)
def edit_counters(t: Tables) -> DataFrame:
    return edited(t).summary()


# --- wide tables ---


@workload(
    "R10_materialize",
    f"""WITH {VAULT_SQL.lstrip()}
SELECT {uuid5_sql("k")} AS entidad_interna_id, k AS llave_humana_completa, 'carga_masiva' AS origen_dato,
       CAST(NULL AS VARCHAR) AS creado_por, max(desde) AS actualizado_en,
       max(limpio) FILTER (prop = 'c_custkey') AS c_custkey, max(limpio) FILTER (prop = 'c_name') AS c_name,
       max(limpio) FILTER (prop = 'c_mktsegment') AS c_mktsegment,
       CAST(max(limpio) FILTER (prop = 'c_acctbal') AS DOUBLE) AS c_acctbal
FROM vault WHERE estado = 'VIGENTE' GROUP BY k""",
)
def materialized(t: Tables) -> DataFrame:
    """The wide table after the second snapshot is that snapshot, cleaned."""
    store, _ = stored_runs(t)
    table = f"{scratch_database(t.spark)}.wide"
    config = config_table(t, "clientes", CUSTOMER_CONFIG)
    run_materialize(store.vault(), config, source_table="clientes", target_table=table)
    wide = with_days(t.spark.table(table), "actualizado_en")
    return wide.withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@workload(
    "R10_numbers_of_any_scale",
    """WITH n AS (SELECT o_orderkey AS k, CAST(o_orderkey % 1000003 AS VARCHAR) AS w,
       lpad(CAST(o_orderkey AS VARCHAR), 17, '7') AS d, o_orderkey % 18 AS s FROM orders)
SELECT CAST(k AS VARCHAR) AS llave_humana_completa,
       rtrim(CAST(CAST(w || '.' || left(d, CAST(s AS INTEGER)) || '0' AS DECIMAL(38, 17)) AS VARCHAR), '0') AS medida,
       ltrim(w || d || d || d, '0') AS larga
FROM n""",
)
def any_scale(t: Tables) -> DataFrame:
    """Numbers of 0 to 17 decimals share a column without losing a digit; beyond 38 they are texts."""
    whole = (F.col("o_orderkey") % 1000003).cast("string")
    digits = F.lpad(F.col("o_orderkey").cast("string"), 17, "7")
    cut = F.substring(digits, F.lit(1), (F.col("o_orderkey") % 18).cast("int"))
    source = t.orders.select(
        "o_orderkey",
        F.concat(whole, F.lit("."), cut).alias("medida"),
        F.concat(whole, digits, digits, digits).alias("larga"),
    )
    config = [
        ConfigRow("o_orderkey", es_llave=True, guardar=False),
        ConfigRow("medida", "superficie"),
        ConfigRow("larga", "numero"),
    ]
    store = VaultStore(t.spark, f"{scratch_path(t.spark)}/store")
    rows = config_table(t, "pedidos", config)
    run_refine(store, source, rows, source_table="pedidos", job_id="job-1", at=FIRST)
    table = f"{scratch_database(t.spark)}.wide"
    run_materialize(store.vault(), rows, source_table="pedidos", target_table=table)
    return t.spark.table(table).select(
        "llave_humana_completa",
        F.rtrim(F.col("medida").cast("string"), F.lit("0")).alias("medida"),
        "larga",
    )


@workload(
    "A6_conditional_pivot",
    """SELECT CAST(o_orderkey AS VARCHAR) AS llave_humana_completa, o_orderstatus, o_orderpriority, o_totalprice
FROM orders""",
)
def pivoted(t: Tables) -> DataFrame:
    config = [
        ConfigRow("o_orderkey", es_llave=True, guardar=False),
        ConfigRow("o_orderpriority"),
        ConfigRow("o_orderstatus"),
        ConfigRow("o_totalprice", "moneda"),
    ]
    run = refine(
        t.orders,
        config,
        empty(t.spark, VAULT_SCHEMA),
        empty(t.spark, INVENTORY_SCHEMA),
        source_table="pedidos",
        job_id="job-1",
        at=FIRST,
    )
    return wide_entities(run.vault, config, source_table="pedidos").select(
        "llave_humana_completa",
        "o_orderstatus",
        "o_orderpriority",
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
    )


@workload(
    "A7_latest_origin",
    f"""WITH {EDITS_SQL.lstrip()}
SELECT k AS llave_humana_completa, (array_agg(origen_dato ORDER BY desde DESC, prop DESC))[1] AS origen_dato,
       (array_agg(email ORDER BY desde DESC, prop DESC))[1] AS creado_por
FROM vault WHERE estado = 'VIGENTE' GROUP BY k""",
)
def latest_origin(t: Tables) -> DataFrame:
    wide = wide_entities(edited(t).changes, CUSTOMER_CONFIG, source_table="clientes")
    return wide.select("llave_humana_completa", "origen_dato", "creado_por")


@workload(
    "A8_latest_key_and_time",
    f"""WITH {EDITS_SQL.lstrip()}
SELECT {uuid5_sql("k")} AS entidad_interna_id, k AS llave_humana_completa, max(desde) AS actualizado_en
FROM vault WHERE estado = 'VIGENTE' GROUP BY k""",
)
def latest_time(t: Tables) -> DataFrame:
    wide = wide_entities(edited(t).changes, CUSTOMER_CONFIG, source_table="clientes")
    return with_days(wide, "actualizado_en").select(
        "entidad_interna_id", "llave_humana_completa", "actualizado_en"
    )


@workload(
    "A11_materialize_counters",
    f"""WITH {SNAPSHOTS.lstrip()}
SELECT (SELECT count(*) FROM s2) AS entidades_materializadas, 9 AS columnas_creadas, count(*) AS stored
FROM s2""",
)
def materialize_counters(t: Tables) -> DataFrame:
    store, _ = stored_runs(t)
    table = f"{scratch_database(t.spark)}.wide"
    run = run_materialize(store.vault(), config_table(t, "clientes", CUSTOMER_CONFIG), source_table="clientes", target_table=table)
    return t.spark.table(table).agg(
        F.lit(run.entidades_materializadas).cast("long").alias("entidades_materializadas"),
        F.lit(run.columnas_creadas).alias("columnas_creadas"),
        F.count(F.lit(1)).alias("stored"),
    )


@workload(
    "R9_ingest_configuration",
    f"""WITH {SNAPSHOTS.lstrip()} SELECT prop AS propiedad_origen, tipo AS tipo_dato_generico, count(*) AS registros
FROM kv1 GROUP BY prop, tipo""",
)
def configuration(t: Tables) -> DataFrame:
    """The configuration table decides which columns become records, and of which type."""
    rows = load_config(config_table(t, "clientes", CUSTOMER_CONFIG), "clientes")
    run = refine(
        first_customers(t),
        rows,
        empty(t.spark, VAULT_SCHEMA),
        empty(t.spark, INVENTORY_SCHEMA),
        source_table="clientes",
        job_id="job-1",
        at=FIRST,
    )
    return run.changes.groupBy("propiedad_origen", "tipo_dato_generico").agg(
        F.count(F.lit(1)).alias("registros")
    )
