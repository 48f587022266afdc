"""Joins, groupings, summaries, and the reconcile, merge and worktable plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.operators.cross import (
    ColumnPair,
    column_pairs,
    cross,
    cross_summary,
    key_uniqueness,
    state_counts,
)
from cotejo.operators.grouped import grouped
from cotejo.operators.merge import coalesce_suffixes, derive, outer_merge, stack
from cotejo.operators.outer_join import full_outer
from cotejo.plans.outer_merge import merge_sources
from cotejo.plans.reconcile import reconcile, reconcile_summary
from workloads.base import Tables, workload
from workloads.inputs import (
    DAYS_CROSSED,
    DOCUMENTS_CROSSED,
    ORDERS_CROSSED,
    daily_orders,
    daily_shipments,
    order_lines,
)

_DAYS = [ColumnPair("placed", "shipped", "DIFERENCIA")]


def _crossed_days(t: Tables, **how) -> DataFrame:
    return cross(daily_orders(t), daily_shipments(t), "o_orderdate", "l_shipdate", _DAYS, **how)


_CROSSED_DAYS = f"""WITH {DAYS_CROSSED.lstrip()}
SELECT llave_cruce, o_orderdate AS o_orderdate_a, l_shipdate AS l_shipdate_b, estado_cruce,
       placed AS "0_placed_a", shipped AS "0_shipped_b" FROM j"""

workload("J1_full_outer_join", _CROSSED_DAYS)(lambda t: _crossed_days(t, strategy="full"))
workload("J1_full_outer_join_split", _CROSSED_DAYS)(lambda t: _crossed_days(t, strategy="split"))


@workload(
    "J1_full_outer_join_hot_keys",
    """SELECT c_custkey, c_nationkey, s_suppkey, s_nationkey
FROM customer FULL OUTER JOIN supplier ON c_nationkey = s_nationkey""",
)
def hot_nations(t: Tables) -> DataFrame:
    """Few keys with many rows each: every nation above the average is salted."""
    customers = t.customer.select("c_custkey", "c_nationkey")
    suppliers = t.supplier.select("s_suppkey", "s_nationkey")
    return full_outer(customers, suppliers, [("c_nationkey", "s_nationkey")], hot_rows=60)


@workload(
    "J1_full_outer_join_many_hot_keys",
    """WITH a AS (SELECT nullif(l_orderkey % 5, 0) * l_orderkey AS ka, l_linenumber,
                   CASE WHEN l_linenumber = 1 THEN CAST('-0.0' AS DOUBLE) ELSE l_quantity END AS qty
            FROM lineitem),
  b AS (SELECT l_orderkey AS kb, l_linenumber AS other FROM lineitem WHERE l_orderkey % 3 <> 0)
SELECT ka, l_linenumber, CAST(qty AS VARCHAR) AS qty, kb, other FROM a FULL OUTER JOIN b ON ka = kb""",
)
def many_hot_keys(t: Tables) -> DataFrame:
    """Thousands of hot keys, keys of one side, many NULL keys, and a negative zero that stays."""
    key = F.col("l_orderkey")
    signed = F.when(F.col("l_linenumber") == 1, F.lit(-0.0)).otherwise(F.col("l_quantity"))
    a = t.lineitem.select(
        (F.nullif(key % 5, F.lit(0)) * key).alias("ka"), "l_linenumber", signed.alias("qty")
    )
    b = t.lineitem.filter(key % 3 != 0).select(
        key.alias("kb"), F.col("l_linenumber").alias("other")
    )
    joined = full_outer(a, b, [("ka", "kb")], hot_rows=3)
    return joined.withColumn("qty", F.col("qty").cast("string"))


@workload(
    "J2_text_key",
    f"WITH {DAYS_CROSSED.lstrip()} SELECT llave_cruce, count(*) AS rows FROM j GROUP BY llave_cruce",
)
def text_key(t: Tables) -> DataFrame:
    return _crossed_days(t).groupBy("llave_cruce").agg(F.count(F.lit(1)).alias("rows"))


@workload(
    "J3_provenance_label",
    """WITH a AS (SELECT doc_id, nullif(lang, 'en') AS k FROM documents),
  b AS (SELECT DISTINCT nullif(lang, 'fr') AS k FROM documents)
SELECT CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'Match' WHEN a.k IS NOT NULL THEN 'Only A'
       ELSE 'Only B' END AS estado_cruce, doc_id AS "0_doc_id_a"
FROM a FULL OUTER JOIN b ON a.k = b.k""",
)
def provenance_label(t: Tables) -> DataFrame:
    """NULL keys on both sides never match; an A row without key reads as Only B."""
    a = t.documents.select("doc_id", F.nullif("lang", F.lit("en")).alias("k"))
    b = t.documents.select(F.nullif("lang", F.lit("fr")).alias("k")).distinct()
    pairs = [ColumnPair("doc_id", "k", "null_check")]
    return cross(a, b, "k", "k", pairs).select("estado_cruce", "`0_doc_id_a`")


@workload(
    "P1_cross_projection",
    f"""WITH {ORDERS_CROSSED.lstrip()}
SELECT llave_cruce, o_orderkey AS o_orderkey_a, l_orderkey AS l_orderkey_b, estado_cruce,
       o_totalprice AS "0_o_totalprice_a", qty AS "0_qty_b",
       o_totalprice AS "1_o_totalprice_a", n AS "1_n_b" FROM j""",
)
def cross_projection(t: Tables) -> DataFrame:
    pairs = column_pairs("o_totalprice, o_totalprice", "qty, n", "math_add, math_sub")
    return cross(t.orders, order_lines(t), "o_orderkey", "l_orderkey", pairs)


@workload(
    "P3_indexed_names",
    f"""WITH {DOCUMENTS_CROSSED.lstrip()}
SELECT llave_cruce, CAST(llave_cruce AS BIGINT) AS doc_id_a,
       CASE WHEN estado_cruce = 'Match' THEN CAST(llave_cruce AS BIGINT) END AS doc_id_b, estado_cruce,
       n_chars AS "0_n_charsA", quality AS "0_qualityB", 'math_sub' AS "0_metodo_aplicado",
       CAST(n_chars - quality AS DOUBLE) AS "0_math_sub",
       n_chars AS "1_n_charsA", toxic AS "1_toxicB", 'DIFERENCIA' AS "1_metodo_aplicado",
       CAST(toxic - n_chars AS DOUBLE) AS "1_diferencia"
FROM j""",
)
def indexed_names(t: Tables) -> DataFrame:
    pairs = column_pairs("n_chars, n_chars", "quality, toxic", "math_sub, DIFERENCIA")
    documents = t.documents.select("doc_id", "n_chars")
    return reconcile(documents, t.labels, "doc_id", "doc_id", pairs)


# --- merge of two tables ---

_LINE_STATUS = """
  a AS (SELECT l_orderkey AS orderkey, l_linestatus AS status, sum(l_quantity) AS qty,
               min(l_shipdate) AS day FROM lineitem GROUP BY 1, 2),
  b AS (SELECT o_orderkey AS orderkey, o_orderstatus AS status, o_totalprice AS total,
               o_orderdate AS day FROM orders),
  m AS (SELECT coalesce(a.orderkey, b.orderkey) AS orderkey, coalesce(a.status, b.status) AS status,
               qty, total,
               CASE WHEN a.orderkey IS NULL THEN 'Only B' WHEN b.orderkey IS NULL THEN 'Only A'
                    ELSE 'Match' END AS estado_bttf,
               coalesce(a.day, b.day) AS day
        FROM a FULL OUTER JOIN b ON a.orderkey IS NOT DISTINCT FROM b.orderkey
                                AND a.status IS NOT DISTINCT FROM b.status)"""


def _line_status(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(
        F.col("l_orderkey").alias("orderkey"), F.col("l_linestatus").alias("status")
    ).agg(F.sum("l_quantity").alias("qty"), F.min("l_shipdate").alias("day"))


def _order_status(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("orderkey"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderdate").alias("day"),
    )


@workload("J4_outer_merge", f"WITH {_LINE_STATUS.lstrip()} SELECT * FROM m")
def multi_key_merge(t: Tables) -> DataFrame:
    return outer_merge(_line_status(t), _order_status(t), ["orderkey", "status"])


@workload(
    "J4_outer_merge_null_keys",
    """WITH a AS (SELECT nullif(lang, 'en') AS lang, nullif(source, 'src1') AS source, count(*) AS texts
                  FROM documents GROUP BY 1, 2),
  b AS (SELECT nullif(lang, 'en') AS lang, nullif(source, 'src1') AS source, sum(n_chars) AS chars
        FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1, 2)
SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.source, b.source) AS source, texts, chars,
       CASE WHEN texts IS NULL THEN 'Only B' WHEN chars IS NULL THEN 'Only A' ELSE 'Match' END AS estado_bttf
FROM a FULL OUTER JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source""",
)
def merge_null_keys(t: Tables) -> DataFrame:
    keys = {
        "lang": F.nullif("lang", F.lit("en")),
        "source": F.nullif("source", F.lit("src1")),
    }
    documents = t.documents.withColumns(keys)
    texts = documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("texts"))
    chars = (
        documents.join(t.labels, "doc_id", "left_semi")
        .groupBy("lang", "source")
        .agg(F.sum("n_chars").alias("chars"))
    )
    return outer_merge(texts, chars, ["lang", "source"], ordered=True)


@workload(
    "P11_coalesce_suffixes",
    """SELECT l_orderkey, l_linenumber, l_shipdate AS kept_x,
       coalesce(nullif(l_returnflag, 'N'), l_linestatus) AS flag FROM lineitem""",
)
def suffixes(t: Tables) -> DataFrame:
    wide = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.nullif("l_returnflag", F.lit("N")).alias("flag_x"),
        F.col("l_linestatus").alias("flag_y"),
        F.col("l_shipdate").alias("kept_x"),
    )
    return coalesce_suffixes(wide)


@workload(
    "P10_derived_columns",
    """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem""",
)
def derived(t: Tables) -> DataFrame:
    rules = [
        ("net", "l_extendedprice * (1 - l_discount)"),
        ("broken", "no_such_column + 1"),
        ("gross", "net * (1 + l_tax)"),
    ]
    return derive(t.lineitem, rules).select("l_orderkey", "l_linenumber", "net", "gross")


@workload(
    "P10_rules_on_bad_rows",
    """SELECT l_orderkey, l_linenumber,
       CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END AS per_discount,
       TRY_CAST(CASE WHEN l_linenumber > 2 THEN l_returnflag ELSE CAST(l_linenumber AS VARCHAR) END
                AS DOUBLE) + 1 AS number
FROM lineitem""",
)
def rules_on_bad_rows(t: Tables) -> DataFrame:
    """Zero divisors and texts that are no numbers give NULL in their rows; the rest goes on."""
    rows = t.lineitem.withColumn(
        "mixed",
        F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).otherwise(
            F.col("l_linenumber").cast("string")
        ),
    )
    rules = [("per_discount", "l_quantity / l_discount"), ("number", "mixed + 1")]
    return derive(rows, rules).select("l_orderkey", "l_linenumber", "per_discount", "number")


@workload(
    "U1_stack_sources",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""",
)
def stacked(t: Tables) -> DataFrame:
    customers = t.customer.selectExpr(
        "c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"
    )
    suppliers = t.supplier.selectExpr("s_suppkey AS id", "s_acctbal AS balance", "s_name AS name")
    return stack([customers, suppliers])


@workload(
    "R2_outer_merge_job",
    f"""WITH {_LINE_STATUS.lstrip()}, s AS (
  SELECT * FROM a UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal, NULL FROM customer),
  r AS (SELECT coalesce(s.orderkey, b.orderkey) AS orderkey, coalesce(s.status, b.status) AS status,
               qty, total,
               CASE WHEN s.orderkey IS NULL THEN 'Only B' WHEN b.orderkey IS NULL THEN 'Only A'
                    ELSE 'Match' END AS estado_bttf,
               coalesce(s.day, b.day) AS day
        FROM s FULL OUTER JOIN b ON s.orderkey = b.orderkey AND s.status = b.status)
SELECT *, total - qty AS delta FROM r""",
)
def merge_job(t: Tables) -> DataFrame:
    balances = t.customer.selectExpr(
        "c_custkey AS orderkey", "c_mktsegment AS status", "c_acctbal AS qty"
    )
    return merge_sources(
        [_line_status(t), balances],
        [_order_status(t)],
        ["orderkey", "status"],
        [("delta", "total - qty"), ("unknown", "missing_column * 2")],
    )


# --- summaries ---


@workload(
    "A1_reconcile_counts",
    f"""WITH {DAYS_CROSSED.lstrip()}
SELECT count(*) AS "totalRows", count(*) FILTER (estado_cruce = 'Match') AS matches,
       count(*) FILTER (estado_cruce = 'Only A') AS "onlyA",
       count(*) FILTER (estado_cruce = 'Only B') AS "onlyB" FROM j""",
)
def counts(t: Tables) -> DataFrame:
    return state_counts(_crossed_days(t))


@workload(
    "A2_key_uniqueness",
    """SELECT (SELECT count(*) FROM orders) AS total_a, (SELECT count(DISTINCT o_orderkey) FROM orders) AS unique_a,
       (SELECT count(*) FROM lineitem) AS total_b, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS unique_b""",
)
def uniqueness(t: Tables) -> DataFrame:
    return key_uniqueness(t.orders, t.lineitem, "o_orderkey", "l_orderkey")


@workload(
    "A3_duplicate_flag",
    f"""WITH {DAYS_CROSSED.lstrip()}, c AS (
  SELECT count(*) AS total_rows, count(*) FILTER (estado_cruce = 'Match') AS m,
         count(*) FILTER (estado_cruce = 'Only A') AS x, count(*) FILTER (estado_cruce = 'Only B') AS y FROM j)
SELECT total_rows AS "totalRows", m AS matches, x AS "onlyA", y AS "onlyB", false AS "hasDuplicates" FROM c""",
)
def no_duplicates(t: Tables) -> DataFrame:
    a, b = daily_orders(t), daily_shipments(t)
    return cross_summary(_crossed_days(t), key_uniqueness(a, b, "o_orderdate", "l_shipdate"))


@workload(
    "A3_duplicate_flag_repeated_keys",
    """WITH j AS (SELECT c_nationkey, s_nationkey FROM customer FULL OUTER JOIN supplier ON c_nationkey = s_nationkey)
SELECT count(*) AS "totalRows",
       count(*) FILTER (c_nationkey IS NOT NULL AND s_nationkey IS NOT NULL) AS matches,
       count(*) FILTER (s_nationkey IS NULL) AS "onlyA", count(*) FILTER (c_nationkey IS NULL) AS "onlyB",
       true AS "hasDuplicates" FROM j""",
)
def repeated_keys(t: Tables) -> DataFrame:
    return reconcile_summary(t.customer, t.supplier, "c_nationkey", "s_nationkey")


# --- groups ---


@workload("A5_distinct_groups", "SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def distinct_groups(t: Tables) -> DataFrame:
    return grouped(t.lineitem, "l_returnflag, l_linestatus, l_shipdate")


@workload(
    "A5_groups_with_aggregates",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def aggregated_groups(t: Tables) -> DataFrame:
    aggs = {"sum_qty": F.sum("l_quantity"), "n": F.count(F.lit(1))}
    return grouped(t.lineitem, "l_returnflag, l_linestatus", "n DESC", aggs)


@workload(
    "O1_order_rules",
    """SELECT DISTINCT nullif(p_brand, 'Brand#7') AS brand, nullif(p_size, 9) AS size FROM part
ORDER BY brand DESC NULLS FIRST, size ASC NULLS LAST""",
)
def order_rules(t: Tables) -> DataFrame:
    parts = t.part.select(
        F.nullif("p_brand", F.lit("Brand#7")).alias("brand"), F.nullif("p_size", F.lit(9)).alias("size")
    )
    return grouped(parts, ["brand", "size"], "brand DESC, size ASC")


# --- the reconcile plan ---


@workload(
    "R1_reconcile_job",
    f"""WITH {DAYS_CROSSED.lstrip()}
SELECT llave_cruce, o_orderdate AS o_orderdate_a, l_shipdate AS l_shipdate_b, estado_cruce,
       placed AS "0_placedA", shipped AS "0_shippedB", 'DIFERENCIA' AS "0_metodo_aplicado",
       CAST(shipped - placed AS DOUBLE) AS "0_diferencia",
       placed AS "1_placedA", shipped AS "1_shippedB", 'math_diff_pct' AS "1_metodo_aplicado",
       CASE WHEN placed <> 0 THEN CAST(placed - shipped AS DOUBLE) / placed * 100.0 END AS "1_math_diff_pct"
FROM j""",
)
def reconcile_days(t: Tables) -> DataFrame:
    pairs = column_pairs("placed, placed", "shipped, shipped", "DIFERENCIA, math_diff_pct")
    return reconcile(daily_orders(t), daily_shipments(t), "o_orderdate", "l_shipdate", pairs)


_FLAGSHIP = f"""WITH {ORDERS_CROSSED.lstrip()}
SELECT llave_cruce, o_orderkey AS o_orderkey_a, l_orderkey AS l_orderkey_b, estado_cruce,
       o_totalprice AS "0_o_totalpriceA", qty AS "0_qtyB", 'DIFERENCIA' AS "0_metodo_aplicado",
       qty - o_totalprice AS "0_diferencia",
       o_orderdate AS "1_o_orderdateA", ship AS "1_shipB", 'date_equal' AS "1_metodo_aplicado",
       CAST(o_orderdate AS DATE) = CAST(ship AS DATE) AS "1_date_equal"
FROM j"""


@workload("R1_reconcile_orders_lines", _FLAGSHIP)
def flagship(t: Tables) -> DataFrame:
    """Orders against their lines, the headline query."""
    pairs = column_pairs("o_totalprice, o_orderdate", "qty, ship", "DIFERENCIA, date_equal")
    return reconcile(t.orders, order_lines(t), "o_orderkey", "l_orderkey", pairs)
