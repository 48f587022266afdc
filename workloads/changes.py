"""Identity, version chains and entity lifecycle over the test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.operators.inventory import live_counts
from cotejo.operators.records import ENTITY, KEY, identified, property_records, stored_ids
from cotejo.operators.scd2 import apply_changes
from cotejo.operators.state import INVENTORY_SCHEMA, VAULT_SCHEMA, empty
from cotejo.plans.refine import Refinement, refine, run_refine
from cotejo.sources.config import ConfigRow
from cotejo.sources.vault_store import VaultStore
from workloads.base import Tables, scratch_path, workload
from workloads.transforms import uuid5_sql

FIRST, SECOND = datetime(2024, 1, 1), datetime(2024, 1, 2)
DAY = "yyyy-MM-dd"

# --- two snapshots of the customers ---

CUSTOMER_CONFIG = [
    ConfigRow("c_custkey", "internal_id", True, True),
    ConfigRow("c_name", "texto", False, True),
    ConfigRow("c_mktsegment", "texto", False, True),
    ConfigRow("c_acctbal", "moneda", False, True),
    ConfigRow("c_nationkey", "texto", False, False),
]


def first_customers(t: Tables) -> DataFrame:
    """All customers; those in debt are not accepted."""
    return t.customer.withColumn("req_aceptado", F.col("c_acctbal") > 0)


def second_customers(t: Tables) -> DataFrame:
    """Customers with open orders, some with a new balance or segment."""
    is_open = F.col("o_orderstatus") == "P"
    urgent = is_open & (F.col("o_orderpriority") == "1-URGENT")
    orders = t.orders.groupBy("o_custkey").agg(
        F.count_if(is_open).alias("open_orders"), F.count_if(urgent).alias("urgent")
    )
    segment = F.when(F.col("urgent") > 0, F.lit(" URGENT  NOW")).otherwise(F.col("c_mktsegment"))
    balance = F.when(
        F.col("open_orders") > 3, F.col("c_acctbal") + F.col("open_orders")
    ).otherwise(F.col("c_acctbal"))
    return (
        t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"))
        .filter("open_orders > 0")
        .withColumns({"c_mktsegment": segment, "c_acctbal": balance})
        .select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    )


def config_table(t: Tables, source_table: str, config: list[ConfigRow]) -> DataFrame:
    return t.spark.createDataFrame(
        [(source_table, *vars(row).values()) for row in config],
        "tabla string, columna_origen string, tipo_dato_generico string, es_llave boolean, guardar boolean",
    )


def stored_run(
    t: Tables, source: DataFrame, source_table: str, config: list[ConfigRow]
) -> VaultStore:
    """A fresh store holding the outcome of one run."""
    store = VaultStore(t.spark, f"{scratch_path(t.spark)}/store")
    table = config_table(t, source_table, config)
    run_refine(store, source, table, source_table=source_table, job_id="job-1", at=FIRST)
    return store


def first_store(t: Tables) -> VaultStore:
    return stored_run(t, first_customers(t), "clientes", CUSTOMER_CONFIG)


def second_run(t: Tables) -> Refinement:
    store = first_store(t)
    return refine(
        second_customers(t),
        CUSTOMER_CONFIG,
        store.current(1),
        store.inventory(1),
        source_table="clientes",
        job_id="job-2",
        at=SECOND,
    )


def _records_sql(source: str) -> str:
    return f"""
    SELECT CAST(c_custkey AS VARCHAR) AS k, p.prop,
           CASE p.prop WHEN 'c_custkey' THEN CAST(c_custkey AS VARCHAR) WHEN 'c_name' THEN c_name
                       WHEN 'c_mktsegment' THEN c_mktsegment ELSE CAST(c_acctbal AS VARCHAR) END AS original,
           CASE p.prop WHEN 'c_custkey' THEN CAST(c_custkey AS VARCHAR) WHEN 'c_name' THEN c_name
                       WHEN 'c_mktsegment' THEN trim(regexp_replace(c_mktsegment, ' +', ' ', 'g'))
                       ELSE CAST(c_acctbal AS VARCHAR) END AS limpio, p.tipo
    FROM {source}, (VALUES ('c_custkey', 'internal_id'), ('c_name', 'texto'), ('c_mktsegment', 'texto'),
                           ('c_acctbal', 'moneda')) AS p(prop, tipo)"""


SNAPSHOTS = f"""
  s1 AS (SELECT * FROM customer WHERE c_acctbal > 0),
  o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS open_orders,
               count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS urgent
        FROM orders GROUP BY o_custkey),
  s2 AS (SELECT c_custkey, c_name, CASE WHEN urgent > 0 THEN ' URGENT  NOW' ELSE c_mktsegment END AS c_mktsegment,
                CASE WHEN open_orders > 3 THEN c_acctbal + open_orders ELSE c_acctbal END AS c_acctbal
         FROM customer JOIN o ON o_custkey = c_custkey WHERE open_orders > 0),
  kv1 AS ({_records_sql("s1")}),
  kv2 AS ({_records_sql("s2")})"""

# the vault after both snapshots: kept, replaced, removed and new values
VAULT_SQL = f"""{SNAPSHOTS},
  both_runs AS (SELECT a.k AS k1, b.k AS k2, coalesce(a.prop, b.prop) AS prop, a.original AS o1, b.original AS o2,
                       a.limpio AS l1, b.limpio AS l2, coalesce(a.tipo, b.tipo) AS tipo
                FROM kv1 a FULL OUTER JOIN kv2 b ON a.k = b.k AND a.prop = b.prop),
  vault AS (
    SELECT k1 AS k, prop, o1 AS original, l1 AS limpio, tipo,
           CASE WHEN k2 IS NULL THEN 'ELIMINADO' WHEN l1 = l2 THEN 'VIGENTE' ELSE 'HISTORICO' END AS estado,
           CASE WHEN l1 = l2 THEN 'job-1' ELSE 'job-2' END AS job_id, '2024-01-01' AS desde,
           CASE WHEN l1 = l2 THEN NULL ELSE '2024-01-02' END AS hasta
    FROM both_runs WHERE k1 IS NOT NULL
    UNION ALL
    SELECT k2, prop, o2, l2, tipo, 'VIGENTE', 'job-2', '2024-01-02', NULL
    FROM both_runs WHERE k2 IS NOT NULL AND l1 IS DISTINCT FROM l2)"""

VAULT_COLUMNS = f"""{uuid5_sql("k")} AS entidad_interna_id, k AS llave_humana_completa, prop AS propiedad_origen,
  original AS valor_original, limpio AS valor_limpio, sha256(limpio) AS firma_auditoria, tipo AS tipo_dato_generico,
  'clientes' AS tabla_origen, 'carga_masiva' AS origen_dato, CAST(NULL AS VARCHAR) AS creado_por,
  estado, job_id, desde, hasta"""


def with_days(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.date_format(name, DAY) for name in names})


# --- identity ---


@workload(
    "R4_identity_resolution",
    f"""SELECT l_orderkey, l_linenumber, l_linestatus || '|' || CAST(l_orderkey AS VARCHAR) AS llave_humana_completa,
  {uuid5_sql("l_linestatus || '|' || CAST(l_orderkey AS VARCHAR)")} AS entidad_interna_id FROM lineitem""",
)
def resolved(t: Tables) -> DataFrame:
    config = [ConfigRow("l_orderkey", es_llave=True), ConfigRow("l_linestatus", es_llave=True)]
    rows = identified(t.lineitem, config, None)
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        F.col(KEY).alias("llave_humana_completa"),
        F.col(ENTITY).alias("entidad_interna_id"),
    )


@workload(
    "J5_identity_lookup",
    f"""SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'legacy-' || CAST(o_custkey AS VARCHAR)
  ELSE {uuid5_sql("CAST(o_custkey AS VARCHAR)")} END AS entidad_interna_id
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def identity_lookup(t: Tables) -> DataFrame:
    """Some customers were listed earlier under ids of another kind; those ids stay."""
    listed = t.customer.select(
        F.when(
            F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("legacy-"), F.col("c_custkey"))
        ).alias("entidad_interna_id"),
        F.col("c_custkey").cast("string").alias("llave_humana_completa"),
        F.lit("clientes").alias("tabla_origen"),
    ).filter("entidad_interna_id IS NOT NULL")
    config = [ConfigRow("o_custkey", es_llave=True)]
    rows = identified(t.orders, config, stored_ids(listed, "clientes"))
    return rows.select("o_orderkey", F.col(ENTITY).alias("entidad_interna_id"))


@workload(
    "R6_unpivot",
    f"""WITH {SNAPSHOTS.lstrip()}
SELECT k AS llave_humana_completa, prop AS propiedad_origen, original AS valor_original, limpio AS valor_limpio,
       sha256(limpio) AS firma_auditoria, tipo AS tipo_dato_generico FROM kv2""",
)
def unpivoted(t: Tables) -> DataFrame:
    rows = identified(second_customers(t), CUSTOMER_CONFIG, None)
    return property_records(rows, CUSTOMER_CONFIG, source_table="clientes").select(
        "llave_humana_completa",
        "propiedad_origen",
        "valor_original",
        "valor_limpio",
        "firma_auditoria",
        "tipo_dato_generico",
    )


# --- version chains ---

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
LINE_CONFIG = [
    ConfigRow("l_orderkey", "texto", True, False),
    ConfigRow("l_returnflag", "texto", False, True),
    ConfigRow("l_linestatus", "texto", False, True),
    ConfigRow("l_quantity", "numero", False, True),
]
_LINE_RECORDS = """
  kv AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, p.prop,
                CASE p.prop WHEN 'l_returnflag' THEN l_returnflag WHEN 'l_linestatus' THEN l_linestatus
                            ELSE CAST(l_quantity AS VARCHAR) END AS limpio,
                l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
         FROM lineitem, (VALUES ('l_returnflag'), ('l_linestatus'), ('l_quantity')) AS p(prop)),
  c AS (SELECT *, lag(limpio) OVER w AS before FROM kv
        WINDOW w AS (PARTITION BY k, prop ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
  changed AS (SELECT * FROM c WHERE before IS DISTINCT FROM limpio),
  chain AS (SELECT *, lead(limpio) OVER w IS NOT NULL AS followed FROM changed
        WINDOW w AS (PARTITION BY k, prop ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))"""
_CHAIN_SQL = f"""WITH {_LINE_RECORDS.lstrip()}
SELECT k AS llave_humana_completa, prop AS propiedad_origen, limpio AS valor_limpio,
       CASE WHEN followed THEN 'HISTORICO' ELSE 'VIGENTE' END AS estado,
       CASE WHEN followed THEN '2024-01-01' END AS hasta,
       CASE WHEN before IS NULL THEN 'inserted' ELSE 'updated' END AS cambio
FROM chain"""


def line_run(t: Tables, hot_rows: int | None = None) -> Refinement:
    return refine(
        t.lineitem,
        LINE_CONFIG,
        empty(t.spark, VAULT_SCHEMA),
        empty(t.spark, INVENTORY_SCHEMA),
        source_table="lineas",
        job_id="job-1",
        at=FIRST,
        order_by=LINE_ORDER,
        hot_rows=hot_rows,
    )


def _chain_columns(changes: DataFrame) -> DataFrame:
    return with_days(changes, "hasta").select(
        "llave_humana_completa", "propiedad_origen", "valor_limpio", "estado", "hasta", "cambio"
    )


@workload("W1_version_chain", _CHAIN_SQL)
def chains(t: Tables) -> DataFrame:
    """All lines of an order follow each other as versions of its properties."""
    return _chain_columns(line_run(t).changes)


@workload("W1_version_chain_hot_entities", _CHAIN_SQL)
def hot_chains(t: Tables) -> DataFrame:
    """The longest chains go through the range-partitioned path."""
    return _chain_columns(line_run(t, hot_rows=9).changes)


_SHARED = """
  records AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS k, p.prop, CASE p.prop WHEN 'estado' THEN o_orderstatus
             ELSE CAST(o_totalprice AS VARCHAR) END AS limpio, 0 AS new, 0 AS l_linenumber, 0 AS l_partkey,
           0 AS l_suppkey, 0.0 AS l_quantity, 0.0 AS l_extendedprice
    FROM orders, (VALUES ('estado'), ('total')) AS p(prop)
    UNION ALL
    SELECT CAST(l_orderkey AS VARCHAR), p.prop, CASE p.prop WHEN 'estado' THEN l_linestatus
             ELSE CAST(l_quantity AS VARCHAR) END, 1, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
    FROM lineitem, (VALUES ('estado'), ('cantidad')) AS p(prop)),
  c AS (SELECT *, lag(limpio) OVER w AS before FROM records
        WINDOW w AS (PARTITION BY k, prop ORDER BY new, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
  changed AS (SELECT * FROM c WHERE new = 0 OR before IS DISTINCT FROM limpio),
  chain AS (SELECT *, lead(limpio) OVER w IS NOT NULL AS followed FROM changed
        WINDOW w AS (PARTITION BY k, prop ORDER BY new, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
  vault AS (
    SELECT k, prop, limpio, CASE WHEN new = 0 THEN 'pedidos' ELSE 'lineas' END AS tabla_origen,
           CASE WHEN followed THEN 'HISTORICO' ELSE 'VIGENTE' END AS estado,
           CASE WHEN new = 0 AND NOT followed THEN 'job-1' ELSE 'job-2' END AS job_id,
           CASE WHEN new = 0 THEN '2024-01-01' ELSE '2024-01-02' END AS desde,
           CASE WHEN followed THEN '2024-01-02' END AS hasta,
           CASE WHEN new = 1 AND before IS NULL THEN 'inserted' WHEN new = 1 THEN 'updated'
                WHEN followed THEN 'closed' ELSE 'kept' END AS cambio
    FROM chain)"""


def shared_run(t: Tables) -> Refinement:
    """Lines as a second source of the orders' entities: ids do not depend on the source."""
    orders = t.orders.selectExpr("o_orderkey AS pedido", "o_orderstatus AS estado", "o_totalprice AS total")
    key = ConfigRow("pedido", es_llave=True, guardar=False)
    store = stored_run(t, orders, "pedidos", [key, ConfigRow("estado"), ConfigRow("total", "moneda")])
    lines = t.lineitem.withColumns(
        {"pedido": F.col("l_orderkey"), "estado": F.col("l_linestatus"), "cantidad": F.col("l_quantity")}
    )
    return refine(
        lines,
        [key, ConfigRow("estado"), ConfigRow("cantidad", "numero")],
        store.current(1),
        store.inventory(1),
        source_table="lineas",
        job_id="job-2",
        at=SECOND,
        order_by=LINE_ORDER,
    )


@workload(
    "R7_scd2_merge",
    f"""WITH {_SHARED.lstrip()}
SELECT k AS llave_humana_completa, prop AS propiedad_origen, limpio AS valor_limpio, tabla_origen, estado,
       job_id, desde, hasta, cambio FROM vault""",
)
def scd2_merge(t: Tables) -> DataFrame:
    return with_days(shared_run(t).changes, "desde", "hasta").select(
        "llave_humana_completa",
        "propiedad_origen",
        "valor_limpio",
        "tabla_origen",
        "estado",
        "job_id",
        "desde",
        "hasta",
        "cambio",
    )


@workload(
    "J6_current_version_lookup",
    f"""WITH {_SHARED.lstrip()}
SELECT k AS llave_humana_completa, prop AS propiedad_origen, limpio AS valor_limpio FROM vault
WHERE tabla_origen = 'pedidos' AND estado = 'HISTORICO'""",
)
def closed_by_other_source(t: Tables) -> DataFrame:
    """Current versions are found whatever source wrote them."""
    return (
        shared_run(t)
        .changes.filter("cambio = 'closed' AND tabla_origen = 'pedidos'")
        .select("llave_humana_completa", "propiedad_origen", "valor_limpio")
    )


@workload(
    "A9_live_property_count",
    f"""WITH {_SHARED.lstrip()}
SELECT {uuid5_sql("k")} AS entidad_interna_id, CAST(count(*) AS INTEGER) AS live FROM vault
WHERE tabla_origen = 'lineas' AND estado = 'VIGENTE' GROUP BY k""",
)
def live(t: Tables) -> DataFrame:
    return live_counts(shared_run(t).changes, "lineas")


@workload(
    "R5_inventory_shared_ids",
    f"""WITH {_SHARED.lstrip()}, n AS (
  SELECT k, count(*) FILTER (tabla_origen = 'lineas' AND estado = 'VIGENTE') AS live FROM vault GROUP BY k)
SELECT {uuid5_sql("k")} AS entidad_interna_id, k AS llave_humana_completa,
       CASE WHEN live > 0 THEN 'lineas' ELSE 'pedidos' END AS tabla_origen, 'ACTIVO' AS estado_entidad,
       CAST(CASE WHEN live > 0 THEN live ELSE 2 END AS INTEGER) AS total_propiedades_activas,
       CASE WHEN live > 0 THEN '2024-01-02' ELSE '2024-01-01' END AS actualizado_en,
       CASE WHEN live > 0 THEN 'job-2' ELSE 'job-1' END AS job_id
FROM n""",
)
def shared_inventory(t: Tables) -> DataFrame:
    """The last source to see an entity owns its inventory row."""
    return with_days(shared_run(t).inventory(), "actualizado_en")


# --- lifecycle ---


@workload(
    "J7_entities_not_seen",
    f"""WITH {SNAPSHOTS.lstrip()}
SELECT {uuid5_sql("CAST(c_custkey AS VARCHAR)")} AS entidad_interna_id, 'ACTIVO' AS estado_entidad FROM s1
WHERE c_custkey NOT IN (SELECT c_custkey FROM s2)""",
)
def not_seen(t: Tables) -> DataFrame:
    return second_run(t).missing


@workload(
    "J8_removed_rows",
    f"""WITH {VAULT_SQL.lstrip()}
SELECT k AS llave_humana_completa, prop AS propiedad_origen, job_id, hasta FROM vault WHERE estado = 'ELIMINADO'""",
)
def removed_rows(t: Tables) -> DataFrame:
    removed = second_run(t).changes.filter("estado = 'ELIMINADO'")
    return with_days(removed, "hasta").select(
        "llave_humana_completa", "propiedad_origen", "job_id", "hasta"
    )


_INVENTORY = f"""WITH {SNAPSHOTS.lstrip()}, e AS (
  SELECT coalesce(s1.c_custkey, s2.c_custkey) AS c, s2.c_custkey IS NOT NULL AS seen
  FROM s1 FULL OUTER JOIN s2 ON s1.c_custkey = s2.c_custkey)
SELECT {uuid5_sql("CAST(c AS VARCHAR)")} AS entidad_interna_id, CAST(c AS VARCHAR) AS llave_humana_completa,
       'clientes' AS tabla_origen, CASE WHEN seen THEN 'ACTIVO' ELSE 'INACTIVO' END AS estado_entidad,
       CAST(CASE WHEN seen THEN 4 ELSE 0 END AS INTEGER) AS total_propiedades_activas,
       '2024-01-02' AS actualizado_en, CASE WHEN seen THEN 'job-2' ELSE 'job-1' END AS job_id FROM e"""


@workload("R5_inventory_upsert", _INVENTORY)
def inventory(t: Tables) -> DataFrame:
    return with_days(second_run(t).inventory(), "actualizado_en")


@workload(
    "J9_inventory_refresh",
    f"""SELECT entidad_interna_id, estado_entidad, total_propiedades_activas FROM ({_INVENTORY}) AS i""",
)
def refreshed(t: Tables) -> DataFrame:
    return second_run(t).inventory().select(
        "entidad_interna_id", "estado_entidad", "total_propiedades_activas"
    )


@workload(
    "R8_lifecycle_close",
    f"""WITH {VAULT_SQL.lstrip()} SELECT {VAULT_COLUMNS} FROM vault""",
)
def lifecycle(t: Tables) -> DataFrame:
    return with_days(second_run(t).vault, "desde", "hasta")


@workload(
    "W1_chain_operator",
    """WITH e AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
  changed AS (SELECT * FROM e WHERE before IS DISTINCT FROM event_type)
SELECT CAST(user_id AS VARCHAR) AS entidad_interna_id, event_type AS valor_limpio,
       CASE WHEN lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 'VIGENTE' ELSE 'HISTORICO' END AS estado
FROM changed""",
)
def event_chain(t: Tables) -> DataFrame:
    """The chain operator by itself: the last kind of event of every user is the current one."""
    events = t.events
    text = F.lit(None).cast("string")
    records = events.select(
        F.col("user_id").cast("string").alias("entidad_interna_id"),
        F.col("user_id").cast("string").alias("llave_humana_completa"),
        F.lit("event_type").alias("propiedad_origen"),
        F.col("event_type").alias("valor_original"),
        F.col("event_type").alias("valor_limpio"),
        F.sha2("event_type", 256).alias("firma_auditoria"),
        F.lit("texto").alias("tipo_dato_generico"),
        F.lit("eventos").alias("tabla_origen"),
        F.lit("carga_masiva").alias("origen_dato"),
        text.alias("creado_por"),
        F.struct("ts", "event_id").alias("orden"),
    )
    changes = apply_changes(
        empty(t.spark, VAULT_SCHEMA), records, job_id="job-1", at=FIRST
    )
    return changes.select("entidad_interna_id", "valor_limpio", "estado")
