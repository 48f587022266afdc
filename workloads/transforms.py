"""Column transforms over whole tables: normalization, coercion, cleaning, keys, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.functions import cleaning, coerce, identity
from cotejo.functions.operand import Operand, operand
from cotejo.functions.text import normalize_text, to_text
from cotejo.operators.acceptance import accepted, is_accepted, rejected_count
from workloads.base import Tables, workload

TEXT = T.StringType()


def _text(column: Column) -> Operand:
    return Operand(column, TEXT)


@workload(
    "T1_text_normalize",
    r"""SELECT doc_id, strip_accents(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS normalized FROM documents""",
)
def normalized(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", normalize_text(F.col("text")).alias("normalized"))


@workload(
    "T2_to_float",
    """SELECT c_custkey, c_acctbal AS from_double, CAST(c_nationkey AS DOUBLE) AS from_int,
       CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END AS from_bool, c_acctbal AS from_text,
       c_custkey * 1000.0 AS from_grouped, CAST(NULL AS DOUBLE) AS from_name FROM customer""",
)
def floats(t: Tables) -> DataFrame:
    balance = F.concat(F.lit(" "), F.col("c_acctbal").cast("string"), F.lit("\n"))
    grouped = F.concat(F.col("c_custkey").cast("string"), F.lit("_0e2"))
    values = {
        "from_double": operand(t.customer, "c_acctbal"),
        "from_int": operand(t.customer, "c_nationkey"),
        "from_bool": Operand(F.col("c_acctbal") > 0, T.BooleanType()),
        "from_text": _text(balance),
        "from_grouped": _text(grouped),
        "from_name": operand(t.customer, "c_name"),
    }
    return t.customer.select(
        "c_custkey", *[coerce.to_float(value).alias(name) for name, value in values.items()]
    )


@workload(
    "T3_to_bool",
    """SELECT doc_id, quality <> 0 AS from_int, quality <> 0 AS from_text, toxic = 1 AS from_word,
       true AS from_other FROM labels""",
)
def booleans(t: Tables) -> DataFrame:
    labels = t.labels
    word = F.when(F.col("toxic") == 1, F.lit(" SÍ ")).otherwise(F.lit("no"))
    return labels.select(
        "doc_id",
        coerce.to_bool(operand(labels, "quality")).alias("from_int"),
        coerce.to_bool(_text(F.col("quality").cast("string"))).alias("from_text"),
        coerce.to_bool(_text(word)).alias("from_word"),
        coerce.to_bool(Operand(F.current_date(), T.DateType())).alias("from_other"),
    )


@workload(
    "T4_to_list",
    """SELECT p_partkey, replace(p_name, ' ', '|') AS from_commas, replace(p_name, ' ', '|') AS from_json,
       CAST(p_size AS VARCHAR) AS from_number, '{"a": ' || p_name || '}|x' AS from_braces FROM part""",
)
def lists(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    values = {
        "from_commas": _text(F.concat(F.lit(" ,"), F.array_join(words, " , "), F.lit(", "))),
        "from_json": _text(F.to_json(words)),
        "from_number": operand(t.part, "p_size"),
        "from_braces": _text(F.concat(F.lit('{"a": '), F.col("p_name"), F.lit("},x"))),
    }
    return t.part.select(
        "p_partkey",
        *[
            F.array_join(coerce.to_list(value).column.cast("array<string>"), "|").alias(name)
            for name, value in values.items()
        ],
    )


@workload(
    "T5_to_instant",
    """SELECT event_id, form, CASE form
         WHEN 'offset' THEN epoch_us(ts) - 19800000000
         WHEN 'day' THEN (epoch_us(ts) // 86400000000) * 86400000000
         WHEN 'seconds' THEN (epoch_us(ts) // 1000000) * 1000000
         WHEN 'word' THEN NULL ELSE epoch_us(ts) END AS from_text,
       epoch_us(ts) AS from_timestamp, (epoch_us(ts) // 1000) * 1000 AS from_millis
FROM events, (VALUES ('iso'), ('offset'), ('day'), ('seconds'), ('word')) AS f(form)""",
)
def instants(t: Tables) -> DataFrame:
    """Timestamps, milliseconds, and texts in all accepted forms."""
    events = t.events.withColumns(
        {
            "micros": coerce.to_epoch_micros(operand(t.events, "ts")),
            "iso": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        }
    )
    forms = {
        "iso": F.concat(F.lit(" "), "iso", F.lit("Z")),
        "offset": F.concat("iso", F.lit("+05:30")),
        "day": F.date_format("ts", "yyyy-MM-dd"),
        "seconds": F.floor(F.col("micros") / 1_000_000).cast("string"),
        "word": F.col("event_type"),
    }
    pairs = [F.struct(F.lit(name).alias("form"), text.alias("text")) for name, text in forms.items()]
    millis = Operand(F.floor(F.col("micros") / 1_000).cast("long"), T.LongType())
    return events.select("event_id", "micros", F.inline(F.array(*pairs))).select(
        "event_id",
        "form",
        coerce.to_epoch_micros(_text(F.col("text"))).alias("from_text"),
        F.col("micros").alias("from_timestamp"),
        coerce.to_epoch_micros(millis).alias("from_millis"),
    )


@workload(
    "T6_empty_test",
    r"""SELECT doc_id, line, regexp_matches(line, '^\s*$') AS empty
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)""",
)
def empty_lines(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.withColumn("empty", cleaning.is_empty(operand(lines, "line")))


@workload(
    "T7_original_value",
    r"""SELECT doc_id, line, CASE WHEN NOT regexp_matches(line, '^\s*$') THEN line END AS valor_original
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)""",
)
def originals(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.withColumn("valor_original", cleaning.original_value(operand(lines, "line")))


@workload(
    "T8_numeric_clean",
    """SELECT page_id, nullif(regexp_replace(replace(url, ',', '.'), '[^0-9.+-]', '', 'g'), '') AS valor_limpio
FROM pages""",
)
def numeric_clean(t: Tables) -> DataFrame:
    clean = cleaning.clean_value(operand(t.pages, "url"), "numero")
    return t.pages.select("page_id", clean.alias("valor_limpio"))


@workload(
    "T9_text_clean",
    r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS valor_limpio FROM documents""",
)
def text_clean(t: Tables) -> DataFrame:
    clean = cleaning.clean_value(operand(t.documents, "text"), "texto")
    return t.documents.select("doc_id", clean.alias("valor_limpio"))


@workload(
    "T10_typed_clean",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS internal, CAST(NULL AS VARCHAR) AS internal_error,
       CAST(o_totalprice AS VARCHAR) AS price, o_orderpriority AS priority,
       regexp_replace(o_orderpriority, '[^0-9.+-]', '', 'g') AS priority_number,
       CASE WHEN o_orderstatus = 'P' THEN 'internal_id must not be empty' END AS status_error
FROM orders""",
)
def typed_clean(t: Tables) -> DataFrame:
    orders = t.orders
    status = _text(F.when(F.col("o_orderstatus") == "P", F.lit(" ")).otherwise(F.col("o_orderstatus")))
    key = operand(orders, "o_orderkey")
    return orders.select(
        "o_orderkey",
        cleaning.clean_value(key, "Internal_ID ").alias("internal"),
        cleaning.clean_error(key, "internal_id").alias("internal_error"),
        cleaning.clean_value(operand(orders, "o_totalprice"), "moneda").alias("price"),
        cleaning.clean_value(operand(orders, "o_orderpriority"), "texto").alias("priority"),
        cleaning.clean_value(operand(orders, "o_orderpriority"), "peso").alias("priority_number"),
        cleaning.clean_error(status, "internal_id").alias("status_error"),
    )


@workload(
    "T11_audit_hash",
    """SELECT doc_id, sha256(text) AS firma_auditoria, sha256('') AS empty FROM documents""",
)
def audit_hash(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        cleaning.audit_hash(F.col("text")).alias("firma_auditoria"),
        cleaning.audit_hash(F.lit(None).cast("string")).alias("empty"),
    )


@workload(
    "T12_human_key",
    """SELECT l_orderkey, l_linenumber,
       CAST(l_linenumber AS VARCHAR) || '|' || CAST(l_orderkey AS VARCHAR) || '|' ||
       coalesce(nullif(l_returnflag, 'N'), '') AS llave_humana_completa,
       l_linestatus || ' / ' || CAST(l_quantity AS VARCHAR) AS spaced FROM lineitem""",
)
def human_keys(t: Tables) -> DataFrame:
    lines = t.lineitem
    parts = [
        operand(lines, "l_linenumber"),
        operand(lines, "l_orderkey"),
        _text(F.nullif("l_returnflag", F.lit("N"))),
    ]
    spaced = [operand(lines, "l_linestatus"), operand(lines, "l_quantity")]
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        identity.human_key(parts).alias("llave_humana_completa"),
        identity.human_key(spaced, " / ").alias("spaced"),
    )


@workload(
    "T13_anchor_key",
    """SELECT 'ANCLA:' || CAST(event_id AS VARCHAR) AS llave_humana_completa FROM events""",
)
def anchors(t: Tables) -> DataFrame:
    return t.events.select(
        identity.anchor_key(operand(t.events, "event_id")).alias("llave_humana_completa")
    )


def uuid5_sql(key: str) -> str:
    """SQL for the version-5 UUID of a text in the DNS namespace."""
    digest = f"sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode({key}))"
    return f"""regexp_replace({digest},
      '^(.{{8}})(.{{4}}).(.{{3}})(.)(.{{3}})(.{{12}}).*$',
      '\\1-\\2-5\\3-' || substr('89ab89ab89ab89ab', CAST(strpos('0123456789abcdef', substr({digest}, 17, 1)) AS INTEGER), 1) || '\\5-\\6')"""


@workload(
    "T14_entity_id",
    f"""SELECT doc_id, {uuid5_sql("text")} AS from_text, {uuid5_sql("CAST(doc_id AS VARCHAR)")} AS from_id
FROM documents""",
)
def entity_ids(t: Tables) -> DataFrame:
    documents = t.documents.select("doc_id", "text")
    named = identity.with_entity_id(documents, F.col("text"), "from_text")
    return identity.with_entity_id(named, F.col("doc_id").cast("string"), "from_id").drop("text")


@workload(
    "T15_value_text",
    """SELECT l_orderkey, l_linenumber, scale,
       CAST(CASE scale WHEN 'plain' THEN l_extendedprice WHEN 'large' THEN l_extendedprice * 1000
              WHEN 'small' THEN l_discount / 1000 ELSE l_extendedprice * 1e15 END AS VARCHAR) AS number,
       CASE WHEN l_returnflag = 'R' THEN 'True' ELSE 'False' END AS flag,
       strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS shipped
FROM lineitem, (VALUES ('plain'), ('large'), ('small'), ('huge')) AS s(scale)""",
)
def value_texts(t: Tables) -> DataFrame:
    """Doubles of all sizes, from plain decimals to exponents on both ends."""
    price = F.col("l_extendedprice")
    scaled = {
        "plain": price,
        "large": price * 1000,
        "small": F.col("l_discount") / 1000,
        "huge": price * 1e15,
    }
    kinds = [F.struct(F.lit(name).alias("scale"), value.alias("value")) for name, value in scaled.items()]
    numbers = t.lineitem.select("*", F.inline(F.array(*kinds)))
    return numbers.select(
        "l_orderkey",
        "l_linenumber",
        "scale",
        to_text(operand(numbers, "value")).alias("number"),
        to_text(Operand(F.col("l_returnflag") == "R", T.BooleanType())).alias("flag"),
        to_text(operand(numbers, "l_shipdate")).alias("shipped"),
    )


@workload(
    "T16_safe_numeric_cast",
    """SELECT page_id, CAST(TRY_CAST(nullif(regexp_replace(replace(url, ',', '.'), '[^0-9.+-]', '', 'g'), '')
         AS DECIMAL(38, 10)) AS DOUBLE) AS number, url AS words FROM pages""",
)
def safe_cast(t: Tables) -> DataFrame:
    clean = cleaning.clean_value(operand(t.pages, "url"), "numero")
    return t.pages.select(
        "page_id",
        cleaning.typed_value(clean, "numero", "null").cast("double").alias("number"),
        cleaning.typed_value(F.col("url"), "texto").alias("words"),
    )


@workload(
    "T16_decimals_beyond_scale",
    """SELECT o_orderkey, CASE WHEN round(o_totalprice, 1) = o_totalprice
            THEN CAST(CAST(o_totalprice AS DECIMAL(38, 1)) AS DOUBLE) END AS one_decimal,
       o_totalprice AS two_decimals FROM orders""",
)
def decimals_beyond_scale(t: Tables) -> DataFrame:
    """A number with more decimals than its column holds is a bad number, never a shorter one."""
    clean = to_text(operand(t.orders, "o_totalprice"))
    return t.orders.select(
        "o_orderkey",
        cleaning.typed_value(clean, "moneda", "null", 1).cast("double").alias("one_decimal"),
        cleaning.typed_value(clean, "moneda", "fail", 2).cast("double").alias("two_decimals"),
    )


def _judged(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")


@workload(
    "P5_acceptance_filter",
    """SELECT d.doc_id, lang, true AS req_aceptado FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE quality = 1""",
)
def acceptance(t: Tables) -> DataFrame:
    """Documents without a label have no verdict and are not accepted."""
    rows = _judged(t).withColumn("req_aceptado", F.col("quality") == 1)
    return accepted(rows).select("doc_id", "lang", "req_aceptado")


@workload(
    "P6_tolerant_acceptance",
    """SELECT d.doc_id, coalesce(quality <> 0, false) AS from_number, coalesce(toxic = 0, false) AS from_text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def tolerant_acceptance(t: Tables) -> DataFrame:
    numbers = _judged(t).withColumn("REQ_ACEPTADO", F.col("quality"))
    words = F.when(F.col("toxic") == 0, F.lit(" Yes")).when(F.col("toxic") == 1, F.lit("never"))
    texts = numbers.withColumn("REQ_ACEPTADO", words)
    marked = numbers.withColumn("from_number", is_accepted(numbers)).withColumn("REQ_ACEPTADO", words)
    return marked.withColumn("from_text", is_accepted(texts)).select("doc_id", "from_number", "from_text")


@workload(
    "P7_rejected_count",
    """SELECT count(*) AS filas_omitidas FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE (quality = 1) IS DISTINCT FROM true""",
)
def rejects(t: Tables) -> DataFrame:
    return rejected_count(_judged(t).withColumn("req_aceptado", F.col("quality") == 1))
