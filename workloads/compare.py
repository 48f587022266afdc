"""Comparison methods on column pairs of joined tables, under both null rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.functions.methods import PIPELINE, apply_method, evaluate, resolve_method
from cotejo.functions.operand import Operand, operand
from cotejo.operators.cross import ColumnPair, apply_pairs, cross, raw_name
from workloads.base import Tables, workload
from workloads.inputs import (
    DOCUMENTS_CROSSED,
    ORDERS_CROSSED,
    PARTIES_CROSSED,
    PARTS_CROSSED,
    order_lines,
    part_tags,
    part_words,
)

ORDERS = (lambda t: t.orders, order_lines, "o_orderkey", "l_orderkey", ORDERS_CROSSED)
PARTIES = (lambda t: t.customer, lambda t: t.supplier, "c_custkey", "s_suppkey", PARTIES_CROSSED)
DOCUMENTS = (
    lambda t: t.documents.select("doc_id", "lang", "n_chars"),
    lambda t: t.labels,
    "doc_id",
    "doc_id",
    DOCUMENTS_CROSSED,
)
PARTS = (part_words, part_tags, "p_partkey", "p_partkey", PARTS_CROSSED)


def _flat(column: Column, dtype: T.DataType, name: str) -> list[Column]:
    """A result as plain columns: one per field of a struct, lists joined to text."""
    if isinstance(dtype, T.StructType):
        return [column[f.name].alias(f"{name}_{f.name}") for f in dtype]
    if isinstance(dtype, T.ArrayType):
        return [F.array_join(column.cast("array<string>"), "|").alias(name)]
    return [column.alias(name)]


def scored(
    inputs: tuple, col_a: str, col_b: str, method: str, options: dict | None = None
) -> Callable[[Tables], DataFrame]:
    """Key, state, the pipeline result and the scalar result with its match flag."""

    def run(t: Tables) -> DataFrame:
        side_a, side_b, key_a, key_b, _ = inputs
        pair = ColumnPair(col_a, col_b, method, options or {})
        crossed = cross(side_a(t), side_b(t), key_a, key_b, [pair])
        a, b = operand(crossed, raw_name(0, col_a, "a")), operand(crossed, raw_name(0, col_b, "b"))
        piped, _ = apply_method(resolve_method(method, options), a, b, PIPELINE)
        result = crossed.select(
            "llave_cruce",
            "estado_cruce",
            piped.alias("piped"),
            evaluate(a, b, method, options).alias("scalar"),
        )
        kinds = result.schema
        scalar = kinds["scalar"].dataType["result"].dataType
        return result.select(
            "llave_cruce",
            "estado_cruce",
            *_flat(F.col("piped"), kinds["piped"].dataType, "piped"),
            *_flat(F.col("scalar.result"), scalar, "scalar"),
            F.col("scalar.is_match").alias("is_match"),
        )

    return run


def _register(
    name: str,
    inputs: tuple,
    col_a: str,
    col_b: str,
    method: str,
    piped: str,
    scalar: str | None = None,
    match: str = "CAST(NULL AS BOOLEAN)",
    options: dict | None = None,
) -> None:
    """``piped`` and ``scalar`` are SQL select items, without alias for a single value."""
    scalar = scalar or piped.replace("piped_", "scalar_")
    if " AS piped_" not in piped:
        piped, scalar = f"{piped} AS piped", f"{scalar} AS scalar"
    sql = f"""WITH {inputs[4].lstrip()}
SELECT llave_cruce, estado_cruce, {piped}, {scalar}, {match} AS is_match FROM j"""
    workload(name, sql)(scored(inputs, col_a, col_b, method, options))


# --- numbers: order total against the quantity of its lines ---

_SUM = "o_totalprice + qty"
_SUB = "o_totalprice - qty"
_PCT = """CASE WHEN o_totalprice <> 0 THEN (o_totalprice - qty) / o_totalprice * 100.0
     WHEN qty <> 0 THEN CAST('inf' AS DOUBLE) END"""
_RATIO = "CASE WHEN qty <> 0 THEN o_totalprice / qty END"

_register("M1_math_add", ORDERS, "o_totalprice", "qty", "math_add", _SUM)
_register("M2_math_sub", ORDERS, "o_totalprice", "qty", "math_sub", _SUB)
_register("M3_math_diff_abs", ORDERS, "o_totalprice", "qty", "math_diff_abs", f"abs({_SUB})")
_register("M4_math_diff_pct", ORDERS, "o_totalprice", "qty", "math_diff_pct", _PCT)
_register("M6_math_ratio", ORDERS, "o_totalprice", "qty", "math_ratio", _RATIO)


def _tolerance(within: str) -> str:
    return f"""{within} AS piped_is_within_tolerance,
  abs(n - qty) AS piped_delta_abs,
  CASE WHEN n <> 0 THEN abs((n - qty) / n) * 100.0 END AS piped_delta_pct"""


_KNOWN = "(n IS NOT NULL AND qty IS NOT NULL)"
_LINES = (order_lines, order_lines, "l_orderkey", "l_orderkey", f"""{ORDERS_CROSSED.split(",\n  j AS")[0]},
  j AS (SELECT CAST(l_orderkey AS VARCHAR) AS llave_cruce, 'Match' AS estado_cruce, * FROM lines)""")
_register(
    "M5_math_tolerance",
    _LINES,
    "n",
    "qty",
    "math_tolerance",
    _tolerance(_KNOWN),
    match=_KNOWN,
)
_WITHIN = f"({_KNOWN} AND abs(n - qty) <= 80 AND abs((n - qty) / n) * 100.0 <= 2400)"
_register(
    "M5_math_tolerance_limits",
    _LINES,
    "n",
    "qty",
    "math_tolerance",
    _tolerance(_WITHIN),
    match=_WITHIN,
    options={"epsilon": 80, "tolerance_pct": 2400},
)

# --- texts ---

_register(
    "M7_strict_equal",
    DOCUMENTS,
    "n_chars",
    "quality",
    "strict_equal",
    "n_chars = quality",
    "n_chars IS NOT DISTINCT FROM quality",
    "n_chars IS NOT DISTINCT FROM quality",
)
_EQUAL_DAYS = "o_orderdate = ship"
_register(
    "M7_strict_equal_dates",
    ORDERS,
    "o_orderdate",
    "ship",
    "strict_equal",
    _EQUAL_DAYS,
    "o_orderdate IS NOT DISTINCT FROM ship",
    "o_orderdate IS NOT DISTINCT FROM ship",
)


def _normal(column: str) -> str:
    return f"strip_accents(lower(trim({column})))"


_register(
    "M8_normalized_equal",
    ORDERS,
    "o_orderstatus",
    "flag",
    "normalized_equal",
    f"{_normal('o_orderstatus')} = {_normal('flag')}",
    f"coalesce({_normal('o_orderstatus')}, '') = coalesce({_normal('flag')}, '')",
    f"coalesce({_normal('o_orderstatus')}, '') = coalesce({_normal('flag')}, '')",
)


@workload(
    "M8_normalized_equal_texts",
    """
WITH n AS (SELECT doc_id, replace(text, 'ß', 'ss') AS text FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS llave_cruce,
       strip_accents(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) =
       strip_accents(lower(regexp_replace(upper(text), '^\\s+|\\s+$', '', 'g'))) AS "0_normalized_equal"
FROM n""",
)
def normalized_texts(t: Tables) -> DataFrame:
    """Whole documents against their upper-case copies; accents and case must not matter."""
    documents = t.documents.select("doc_id", F.replace("text", F.lit("ß"), F.lit("ss")).alias("text"))
    shouted = documents.select("doc_id", F.upper("text").alias("loud"))
    pairs = [ColumnPair("text", "loud", "normalized_equal")]
    compared = apply_pairs(cross(documents, shouted, "doc_id", "doc_id", pairs), pairs)
    return compared.select("llave_cruce", "`0_normalized_equal`")


_NAMES = "coalesce(c_name, '')", "coalesce(s_name, '')"
_LEVENSHTEIN = f"1.0 - levenshtein({_NAMES[0]}, {_NAMES[1]}) / greatest(length({_NAMES[0]}), length({_NAMES[1]}), 1)"
_register(
    "M9_fuzzy_levenshtein",
    PARTIES,
    "c_name",
    "s_name",
    "fuzzy_levenshtein",
    _LEVENSHTEIN,
    match=f"({_LEVENSHTEIN}) >= 0.85",
)
_register(
    "M9_fuzzy_levenshtein_threshold",
    PARTIES,
    "c_name",
    "s_name",
    "fuzzy_levenshtein",
    _LEVENSHTEIN,
    match=f"({_LEVENSHTEIN}) >= 0.5",
    options={"threshold": 0.5},
)

# Jaro as a fold over the letters of A: each takes the first free equal letter of B in reach.
_JARO_WINKLER = """
  s AS (SELECT llave_cruce, estado_cruce, p_name AS x, p_type AS y, length(p_name) AS n,
               length(p_type) AS m,
               greatest(0, greatest(length(p_name), length(p_type)) // 2 - 1) AS reach
        FROM (SELECT llave_cruce, estado_cruce, lower(p_name) AS p_name, lower(p_type) AS p_type FROM j)),
  f AS (SELECT *, list_reduce(range(1, n + 1), lambda taken, i: list_append(taken, coalesce(
                 list_filter(range(greatest(1, i - reach), least(m, i + reach) + 1),
                   lambda p: substr(y, CAST(p AS INTEGER), 1) = substr(x, CAST(i AS INTEGER), 1)
                             AND NOT list_contains(taken, p))[1], 0)),
               CAST([] AS BIGINT[])) AS taken FROM s),
  g AS (SELECT *, list_filter(range(1, n + 1), lambda i: taken[i] > 0) AS at_x,
               list_sort(list_filter(taken, lambda p: p > 0)) AS at_y FROM f),
  h AS (SELECT *, len(at_y) AS c,
               len(list_filter(range(1, len(at_y) + 1), lambda k:
                   substr(x, CAST(at_x[k] AS INTEGER), 1) <> substr(y, CAST(at_y[k] AS INTEGER), 1))) / 2 AS t,
               len(list_filter(range(1, 5), lambda k: k <= least(n, m) AND substr(x, 1, CAST(k AS INTEGER)) = substr(y, 1, CAST(k AS INTEGER)))) AS prefix
        FROM g),
  r AS (SELECT *, CASE WHEN x = y THEN 1.0 WHEN c = 0 THEN 0.0
                       ELSE (c / n + c / m + (c - t) / c) / 3.0 END AS jaro FROM h)"""


@workload(
    "M10_fuzzy_jaro_winkler",
    f"""WITH {PARTS_CROSSED.lstrip()},{_JARO_WINKLER}
SELECT llave_cruce, estado_cruce, round(jaro + prefix * 0.1 * (1.0 - jaro), 9) AS score,
       jaro + prefix * 0.1 * (1.0 - jaro) >= 0.85 AS is_match FROM r""",
)
def jaro_winkler_names(t: Tables) -> DataFrame:
    pairs = [ColumnPair("name", "kind", "fuzzy_jaro_winkler")]
    names = t.part.select("p_partkey", F.lower("p_name").alias("name"))
    kinds = t.part.select("p_partkey", F.lower("p_type").alias("kind"))
    compared = apply_pairs(cross(names, kinds, "p_partkey", "p_partkey", pairs), pairs)
    return compared.select(
        "llave_cruce",
        "estado_cruce",
        F.round("`0_fuzzy_jaro_winkler`", 9).alias("score"),
        F.col("`0_is_match`").alias("is_match"),
    )


_STATUS = "contains(coalesce({0}, ''), coalesce({1}, '')) OR contains(coalesce({1}, ''), coalesce({0}, ''))"
_CONTAINS = f"({_STATUS.format('o_orderpriority', 'flag')})"
_register(
    "M11_contains_check",
    ORDERS,
    "o_orderpriority",
    "flag",
    "contains_check",
    _CONTAINS,
    match=_CONTAINS,
)
_SEARCH = "regexp_matches(coalesce(o_orderpriority, ''), coalesce(flag, 'None'))"
_register(
    "M12_regex_match", ORDERS, "o_orderpriority", "flag", "regex_match", _SEARCH, match=_SEARCH
)
_FIXED = "regexp_matches(coalesce(o_orderpriority, ''), '(?i)^[1-3]-(high|m)')"
_register(
    "M12_regex_match_option",
    ORDERS,
    "o_orderpriority",
    "flag",
    "regex_match",
    _FIXED,
    match=_FIXED,
    options={"pattern": "^[1-3]-(high|m)", "ignore_case": True},
)


@workload(
    "M12_regex_match_per_row",
    f"""WITH {ORDERS_CROSSED.lstrip()}
SELECT llave_cruce,
       regexp_matches(coalesce(o_orderpriority, ''),
                      coalesce('^[' || CAST(n AS VARCHAR) || ']-.*[M' || flag || ']', 'None')) AS "0_regex_match"
FROM j""",
)
def regex_per_row(t: Tables) -> DataFrame:
    """Every order brings its own pattern, made from its line count and flag."""
    pattern = F.concat(F.lit("^["), F.col("n").cast("string"), F.lit("]-.*[M"), F.col("flag"), F.lit("]"))
    pairs = [ColumnPair("o_orderpriority", "pattern", "regex_match", {"dialect": "shared"})]
    lines = order_lines(t).withColumn("pattern", pattern)
    compared = apply_pairs(cross(t.orders, lines, "o_orderkey", "l_orderkey", pairs), pairs)
    return compared.select("llave_cruce", "`0_regex_match`")


# --- dates ---

_SECONDS = "abs(epoch_us(o_orderdate) - epoch_us(ship)) / 1e6"
_register("M13_date_diff_seconds", ORDERS, "o_orderdate", "ship", "date_diff_seconds", _SECONDS)
_register(
    "M14_date_diff_days", ORDERS, "o_orderdate", "ship", "date_diff_days", f"{_SECONDS} / 86400.0"
)
_SAME_DAY = "CAST(o_orderdate AS DATE) = CAST(ship AS DATE)"
_register(
    "M15_date_equal", ORDERS, "o_orderdate", "ship", "date_equal", _SAME_DAY, match=_SAME_DAY
)


def _date_tolerance(limit: int) -> str:
    return f"""{_SECONDS} <= {limit} AS piped_is_within_tolerance,
  {_SECONDS} AS piped_delta_seconds"""


_register(
    "M16_date_tolerance",
    ORDERS,
    "o_orderdate",
    "ship",
    "date_tolerance",
    _date_tolerance(0),
    match=f"{_SECONDS} <= 0",
)
_register(
    "M16_date_tolerance_week",
    ORDERS,
    "o_orderdate",
    "ship",
    "date_tolerance",
    _date_tolerance(604800),
    match=f"{_SECONDS} <= 604800",
    options={"tolerance_seconds": 604800},
)

# --- lists ---

_X = "list_transform(string_split(words, ','), lambda w: trim(w))"
_Y = "list_transform(string_split(tags, ','), lambda w: trim(w))"
_IN_BOTH = f"list_filter({_X}, lambda w: list_contains({_Y}, w))"
_ONLY_X = f"list_filter({_X}, lambda w: NOT list_contains({_Y}, w))"
_register(
    "M17_array_intersection",
    PARTS,
    "words",
    "tags",
    "array_intersection",
    f"array_to_string({_IN_BOTH}, '|')",
)
_register(
    "M18_array_difference",
    PARTS,
    "words",
    "tags",
    "array_difference",
    f"array_to_string({_ONLY_X}, '|')",
)
_JACCARD = f"len(list_distinct({_IN_BOTH})) / len(list_distinct(list_concat({_X}, {_Y})))"
_register(
    "M19_array_jaccard",
    PARTS,
    "words",
    "tags",
    "array_jaccard",
    _JACCARD,
    match=f"{_JACCARD} >= 0.85",
)

_MIXED_A = """'[' || p_size || ', "' || p_size || '", ' || p_size || '.0, "k", null, 1e2, 100]'"""
_MIXED_B = """CASE p_partkey % 4 WHEN 0 THEN '["' || p_size || '"]' WHEN 1 THEN '[' || p_size || '.0, 100.0]'
  WHEN 2 THEN '[null, "k"]' ELSE CAST(p_size AS STRING) || ', k' END"""


def _mixed_lists(t: Tables) -> tuple[DataFrame, Operand, Operand]:
    """Numbers, texts and nulls in one JSON array; the last quarter of the others is no JSON."""
    df = t.part.select("p_partkey", F.expr(_MIXED_A).alias("a"), F.expr(_MIXED_B).alias("b"))
    return df, operand(df, "a"), operand(df, "b")


@workload(
    "M18_array_difference_of_mixed_items",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || '|k|None|100.0'
         WHEN 1 THEN p_size || '|k|None' WHEN 2 THEN p_size || '|' || p_size || '|100.0'
         ELSE p_size || '|None|100.0' END AS only_a FROM part WHERE p_size <> 100""",
)
def mixed_difference(t: Tables) -> DataFrame:
    """A number differs from the text of its digits and equals the same number with a point."""
    df, a, b = _mixed_lists(t)
    found, _ = apply_method(resolve_method("array_difference"), a, b, PIPELINE)
    return df.select("p_partkey", F.array_join(found, "|", "None").alias("only_a"))


@workload(
    "M19_array_jaccard_of_mixed_items",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1 / 5 WHEN 1 THEN 2 / 5 WHEN 2 THEN 2 / 5
         ELSE 2 / 5 END AS shared FROM part WHERE p_size <> 100""",
)
def mixed_jaccard(t: Tables) -> DataFrame:
    df, a, b = _mixed_lists(t)
    found, _ = apply_method(resolve_method("array_jaccard"), a, b, PIPELINE)
    return df.select("p_partkey", found.alias("shared"))


# --- structure and logic ---

_NULLS = """lang IS NULL AS piped_a_is_null, quality IS NULL AS piped_b_is_null,
  lang IS NULL AND quality IS NULL AS piped_both_null,
  lang IS NULL OR quality IS NULL AS piped_any_null"""
_register(
    "M20_null_check",
    DOCUMENTS,
    "lang",
    "quality",
    "null_check",
    _NULLS,
    match="NOT (lang IS NULL OR quality IS NULL)",
)
for _operator, _symbol in (("AND", "AND"), ("OR", "OR"), ("XOR", "<>")):
    _LOGIC = f"(n_chars <> 0) {_symbol} (quality <> 0)"
    _COALESCED = f"coalesce(n_chars <> 0, false) {_symbol} coalesce(quality <> 0, false)"
    _register(
        f"M21_boolean_logic_{_operator.lower()}",
        DOCUMENTS,
        "n_chars",
        "quality",
        "boolean_logic",
        _LOGIC,
        _COALESCED,
        _COALESCED,
        {"operator": _operator},
    )


# --- aliases, match flags, errors, several pairs at once ---


@workload(
    "M22_aliases",
    f"""WITH {ORDERS_CROSSED.lstrip()}
SELECT llave_cruce, o_orderkey AS o_orderkey_a, l_orderkey AS l_orderkey_b, estado_cruce,
       o_totalprice AS "0_o_totalpriceA", qty AS "0_qtyB", 'DIFERENCIA' AS "0_metodo_aplicado",
       qty - o_totalprice AS "0_diferencia",
       o_orderstatus AS "1_o_orderstatusA", flag AS "1_flagB", 'Igualdad' AS "1_metodo_aplicado",
       o_orderstatus = flag AS "1_igualdad"
FROM j""",
)
def aliases(t: Tables) -> DataFrame:
    pairs = [
        ColumnPair("o_totalprice", "qty", "DIFERENCIA"),
        ColumnPair("o_orderstatus", "flag", "Igualdad"),
    ]
    return apply_pairs(cross(t.orders, order_lines(t), "o_orderkey", "l_orderkey", pairs), pairs)


@workload(
    "M23_match_inference",
    f"""WITH {PARTIES_CROSSED.lstrip()}, s AS (SELECT *, {_LEVENSHTEIN} AS score FROM j)
SELECT llave_cruce,
       c_acctbal IS NOT NULL AND s_acctbal IS NOT NULL AND abs(c_acctbal - s_acctbal) <= 2500 AS tolerance,
       score >= 0.6 AS similarity,
       NOT (c_name IS NULL OR s_name IS NULL) AS nulls,
       c_nationkey IS NOT DISTINCT FROM s_nationkey AS equality,
       CAST(NULL AS BOOLEAN) AS difference
FROM s""",
)
def match_inference(t: Tables) -> DataFrame:
    pairs = [ColumnPair(f"c_{name}", f"s_{name}", "IGUALDAD") for name in ("acctbal", "name", "nationkey")]
    crossed = cross(t.customer, t.supplier, "c_custkey", "s_suppkey", pairs)
    balance, name, nation = (
        (operand(crossed, raw_name(i, p.col_a, "a")), operand(crossed, raw_name(i, p.col_b, "b")))
        for i, p in enumerate(pairs)
    )
    flags = {
        "tolerance": evaluate(*balance, "math_tolerance", {"epsilon": 2500}),
        "similarity": evaluate(*name, "fuzzy_levenshtein", {"threshold": 0.6}),
        "nulls": evaluate(*name, "null_check"),
        "equality": evaluate(*nation, "strict_equal"),
        "difference": evaluate(*balance, "math_sub"),
    }
    return crossed.select(
        "llave_cruce", *[flag["is_match"].alias(title) for title, flag in flags.items()]
    )


@workload(
    "M24_error_capture",
    f"""WITH {ORDERS_CROSSED.lstrip()}
SELECT llave_cruce, CAST(NULL AS BOOLEAN) AS date_result,
       'not a date: ' || coalesce(o_orderpriority, 'null') AS date_error,
       CAST(NULL AS BOOLEAN) AS unknown_result, true AS unknown_failed
FROM j""",
)
def error_capture(t: Tables) -> DataFrame:
    pairs = [ColumnPair("o_orderpriority", "ship", "date_equal")]
    crossed = cross(t.orders, order_lines(t), "o_orderkey", "l_orderkey", pairs)
    a, b = operand(crossed, "0_o_orderpriority_a"), operand(crossed, "0_ship_b")
    dates, unknown = evaluate(a, b, "date_equal"), evaluate(a, b, "soundex_equal")
    return crossed.select(
        "llave_cruce",
        dates["result"].alias("date_result"),
        dates["error"].alias("date_error"),
        unknown["result"].alias("unknown_result"),
        unknown["error"].isNotNull().alias("unknown_failed"),
    )


@workload(
    "M25_pair_application",
    f"""WITH {ORDERS_CROSSED.lstrip()}
SELECT llave_cruce, o_orderkey AS o_orderkey_a, l_orderkey AS l_orderkey_b, estado_cruce,
       o_totalprice AS "0_o_totalpriceA", qty AS "0_qtyB", 'math_ratio' AS "0_metodo_aplicado",
       {_RATIO} AS "0_math_ratio",
       o_orderdate AS "1_o_orderdateA", ship AS "1_shipB", 'date_diff_days' AS "1_metodo_aplicado",
       {_SECONDS} / 86400.0 AS "1_date_diff_days", CAST(NULL AS BOOLEAN) AS "1_is_match",
       o_totalprice AS "2_o_totalpriceA", n AS "2_nB", 'MATH_ADD' AS "2_metodo_aplicado",
       o_totalprice + n AS "2_math_add",
       o_orderstatus AS "3_o_orderstatusA", flag AS "3_flagB",
       'fuzzy_levenshtein' AS "3_metodo_aplicado",
       CASE WHEN flag IS NULL THEN 0.0 WHEN o_orderstatus = flag THEN 1.0 ELSE 0.0 END AS "3_fuzzy_levenshtein",
       flag IS NOT NULL AND o_orderstatus = flag AS "3_is_match"
FROM j""",
)
def pair_application(t: Tables) -> DataFrame:
    pairs = [
        ColumnPair("o_totalprice", "qty", "math_ratio"),
        ColumnPair("o_orderdate", "ship", "date_diff_days"),
        ColumnPair("o_totalprice", "n", "MATH_ADD"),
        ColumnPair("o_orderstatus", "flag", "fuzzy_levenshtein"),
    ]
    return apply_pairs(cross(t.orders, order_lines(t), "o_orderkey", "l_orderkey", pairs), pairs)
