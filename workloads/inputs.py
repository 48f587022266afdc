"""Inputs derived from the test tables, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workloads.base import Tables


def order_lines(t: Tables) -> DataFrame:
    """Lines of each order: total quantity, count, first shipping day, a flag."""
    return t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"),
        F.count(F.lit(1)).alias("n"),
        F.min("l_shipdate").alias("ship"),
        F.max("l_returnflag").alias("flag"),
    )


ORDER_LINES = """
  lines AS (SELECT l_orderkey, sum(l_quantity) AS qty, count(*) AS n, min(l_shipdate) AS ship,
                   max(l_returnflag) AS flag
            FROM lineitem GROUP BY l_orderkey)"""

ORDERS_CROSSED = f"""{ORDER_LINES},
  j AS (SELECT coalesce(CAST(o_orderkey AS VARCHAR), CAST(l_orderkey AS VARCHAR)) AS llave_cruce,
               CASE WHEN o_orderkey IS NOT NULL AND l_orderkey IS NOT NULL THEN 'Match'
                    WHEN o_orderkey IS NOT NULL THEN 'Only A' ELSE 'Only B' END AS estado_cruce,
               *
        FROM orders FULL OUTER JOIN lines ON o_orderkey = l_orderkey)"""


def daily_orders(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("placed"))


def daily_shipments(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("shipped"))


DAYS_CROSSED = """
  a AS (SELECT o_orderdate, count(*) AS placed FROM orders GROUP BY o_orderdate),
  b AS (SELECT l_shipdate, count(*) AS shipped FROM lineitem GROUP BY l_shipdate),
  j AS (SELECT coalesce(CAST(o_orderdate AS VARCHAR), CAST(l_shipdate AS VARCHAR)) AS llave_cruce,
               CASE WHEN o_orderdate IS NOT NULL AND l_shipdate IS NOT NULL THEN 'Match'
                    WHEN o_orderdate IS NOT NULL THEN 'Only A' ELSE 'Only B' END AS estado_cruce,
               *
        FROM a FULL OUTER JOIN b ON o_orderdate = l_shipdate)"""

PARTIES_CROSSED = """
  j AS (SELECT coalesce(CAST(c_custkey AS VARCHAR), CAST(s_suppkey AS VARCHAR)) AS llave_cruce,
               CASE WHEN c_custkey IS NOT NULL AND s_suppkey IS NOT NULL THEN 'Match'
                    WHEN c_custkey IS NOT NULL THEN 'Only A' ELSE 'Only B' END AS estado_cruce,
               *
        FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey)"""

DOCUMENTS_CROSSED = """
  j AS (SELECT coalesce(CAST(d.doc_id AS VARCHAR), CAST(l.doc_id AS VARCHAR)) AS llave_cruce,
               CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 'Match'
                    WHEN d.doc_id IS NOT NULL THEN 'Only A' ELSE 'Only B' END AS estado_cruce,
               d.*, l.quality, l.toxic
        FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id)"""

PARTS_CROSSED = """
  j AS (SELECT CAST(a.p_partkey AS VARCHAR) AS llave_cruce, 'Match' AS estado_cruce,
               a.p_name, a.p_size, replace(a.p_name, ' ', ', ') AS words,
               b.p_type, lower(b.p_type) || ',ring,' || lower(b.p_brand) AS tags,
               b.p_retailprice
        FROM part a JOIN part b ON a.p_partkey = b.p_partkey)"""


def part_words(t: Tables) -> DataFrame:
    return t.part.withColumn("words", F.replace("p_name", F.lit(" "), F.lit(", ")))


def part_tags(t: Tables) -> DataFrame:
    tags = F.concat(F.lower("p_type"), F.lit(",ring,"), F.lower("p_brand"))
    return t.part.withColumn("tags", tags)
