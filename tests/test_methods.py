import json
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cotejo.functions import coerce
from cotejo.functions.methods import (
    METHODS,
    PIPELINE,
    apply_method,
    evaluate,
    resolve_method,
)
from cotejo.functions.operand import operand
from cotejo.functions.patterns import search_column
from cotejo.functions.similarity import jaro_winkler_text
from cotejo.functions.text import squeeze_blanks, normalize_text, to_text


def scored(spark, method, a, b, options=None, schema="a string, b string"):
    df = spark.createDataFrame([(a, b)], schema)
    return df.select(
        evaluate(operand(df, "a"), operand(df, "b"), method, options).alias("r")
    ).first()["r"]


def piped(spark, method, rows, schema, options=None):
    df = spark.createDataFrame(rows, schema)
    result, match = apply_method(
        resolve_method(method, options), operand(df, "a"), operand(df, "b"), PIPELINE
    )
    return [tuple(row) for row in df.select(result.alias("r"), match.alias("m")).collect()]


def test_all_methods_are_registered():
    assert sorted(METHODS) == sorted(
        "math_add math_sub math_diff_abs math_diff_pct math_tolerance math_ratio strict_equal "
        "normalized_equal fuzzy_levenshtein fuzzy_jaro_winkler contains_check regex_match "
        "date_diff_seconds date_diff_days date_equal date_tolerance array_intersection "
        "array_difference array_jaccard null_check boolean_logic".split()
    )


@pytest.mark.parametrize(
    ("method", "a", "b", "expected"),
    [
        ("math_add", 10.0, 5.0, 15.0),
        ("math_sub", 10.0, 5.0, 5.0),
        ("math_diff_abs", 10.0, 7.0, 3.0),
        ("math_diff_pct", 100.0, 80.0, 20.0),
        ("math_diff_pct", 0.0, 5.0, math.inf),
        ("math_diff_pct", 0.0, 0.0, None),
        ("math_ratio", 10.0, 2.0, 5.0),
        ("math_ratio", 10.0, 0.0, None),
        ("math_add", None, 1.0, None),
    ],
)
def test_numbers(spark, method, a, b, expected):
    row = scored(spark, method, a, b, schema="a double, b double")
    assert (row["result"], row["error"]) == (expected, None)


def test_numbers_from_texts(spark):
    assert scored(spark, "math_add", " 1_000 ", "0.5")["result"] == 1000.5
    assert scored(spark, "math_add", "1d", "0.5")["result"] is None


def test_tolerance(spark):
    doubles = "a double, b double"
    row = scored(spark, "math_tolerance", 100.0, 102.0, {"epsilon": 5}, doubles)
    assert (row["result"]["is_within_tolerance"], row["is_match"]) == (True, True)
    assert row["result"]["delta_abs"] == row["result"]["delta_pct"] == 2.0
    percent = scored(spark, "math_tolerance", 100.0, 102.0, {"tolerance_pct": 1}, doubles)
    assert percent["is_match"] is False
    zero = scored(spark, "math_tolerance", 0.0, 0.0, {"tolerance_pct": 1}, doubles)
    assert (zero["is_match"], zero["result"]["delta_pct"]) == (True, None)
    missing = scored(spark, "math_tolerance", None, 1.0, None, doubles)["result"]
    assert tuple(missing) == (False, None, None)


@pytest.mark.parametrize(
    ("method", "a", "b", "options", "expected"),
    [
        ("strict_equal", "Hola", "Hola", None, True),
        ("strict_equal", None, None, None, True),
        ("strict_equal", None, "x", None, False),
        ("normalized_equal", " Café", "cafe", None, True),
        ("normalized_equal", "Straße", "strasse", None, False),
        ("normalized_equal", None, "", None, True),
        ("fuzzy_levenshtein", "kitten", "sitting", None, 1 - 3 / 7),
        ("fuzzy_levenshtein", None, "", None, 1.0),
        ("fuzzy_levenshtein", "niño", "nino", None, 0.75),
        ("fuzzy_jaro_winkler", "martha", "martha", None, 1.0),
        ("contains_check", "world", "hello world", None, True),
        ("contains_check", None, "x", None, True),
        ("regex_match", "abc-123", None, {"pattern": r"^[a-z]+-\d+$"}, True),
        ("regex_match", "ABC", None, {"pattern": "b", "ignore_case": True}, True),
        ("regex_match", "ABC", None, {"pattern": r"(?P<x>A)(?P=x)?B"}, True),
        ("regex_match", "xNone", None, None, True),
        ("regex_match", "abc", "^a.c$", None, True),
        ("boolean_logic", "yes", "no", None, False),
        ("boolean_logic", "yes", None, {"operator": "or"}, True),
        ("boolean_logic", "SÍ", "0", {"operator": "XOR"}, True),
    ],
)
def test_texts_and_logic(spark, method, a, b, options, expected):
    assert scored(spark, method, a, b, options)["result"] == expected


def test_values_of_different_kinds_are_never_equal(spark):
    assert scored(spark, "strict_equal", 1, "1", schema="a int, b string")["result"] is False
    assert scored(spark, "strict_equal", 1, 1.0, schema="a int, b double")["result"] is True
    assert scored(spark, "strict_equal", True, 1, schema="a boolean, b int")["result"] is True


def test_dates(spark):
    first, third = "2024-01-01T00:00:00Z", "2024-01-03T00:00:00Z"
    assert scored(spark, "date_diff_days", first, third)["result"] == 2.0
    assert scored(spark, "date_diff_seconds", first, third)["result"] == 172800.0
    assert scored(spark, "date_equal", first, third)["result"] is False
    assert scored(spark, "date_equal", "2024-01-01 00:00:00", "2024-01-01 23:59:59")["result"]
    within = scored(spark, "date_tolerance", first, third, {"tolerance_seconds": 200000})
    assert (within["is_match"], within["result"]["delta_seconds"]) == (True, 172800.0)
    bad = scored(spark, "date_equal", first, "soon")
    assert (bad["result"], bad["error"]) == (None, "not a date: soon")


def test_instants(spark):
    cases = {
        "2024-01-15T10:30:00Z": datetime(2024, 1, 15, 10, 30),
        "2024-01-15 10:30:00": datetime(2024, 1, 15, 10, 30),
        " 2024-01-15 ": datetime(2024, 1, 15),
        "2024-01-15x10": datetime(2024, 1, 15, 10),
        "2024-01-15T10:30:00.123456+05:30": datetime(2024, 1, 15, 5, 0, 0, 123456),
        "2024-01-15T10:30:00.123z": datetime(2024, 1, 15, 10, 30, 0, 123000),
        "1700000000000": datetime(2023, 11, 14, 22, 13, 20),
        "1700000000": datetime(2023, 11, 14, 22, 13, 20),
        "2024-01-15T10:30:00.1": None,
        "2024-1-15": None,
        "2024-02-30": None,
        "2024-01-15T": None,
        "": None,
    }
    df = spark.createDataFrame([(text,) for text in cases], "a string")
    micros = coerce.to_epoch_micros(operand(df, "a"))
    spark.conf.set("spark.sql.session.timeZone", "America/Lima")
    try:  # the session time zone must not matter
        got = dict(df.select("a", micros.alias("m")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    epoch = datetime(1970, 1, 1)
    for text, instant in cases.items():
        wanted = None if instant is None else round((instant - epoch).total_seconds() * 1e6)
        assert got[text] == wanted, text


def test_lists(spark):
    ints = "a array<int>, b array<int>"
    assert scored(spark, "array_intersection", [1, 2, 3], [2, 3, 4], schema=ints)["result"] == [2, 3]
    assert scored(spark, "array_difference", [1, 2, 3], [2], schema=ints)["result"] == [1, 3]
    assert scored(spark, "array_jaccard", [1, 2], [2, 3], schema=ints)["result"] == 1 / 3
    assert scored(spark, "array_jaccard", None, "", schema="a string, b string")["result"] == 1.0
    mixed = "a array<int>, b string"
    assert scored(spark, "array_intersection", [1, 2, 2], '["2", 3]', schema=mixed)["result"] == [2]
    assert scored(spark, "array_difference", [1, 2], '["2"]', schema=mixed)["result"] == [1, 2]
    assert scored(spark, "array_jaccard", [1, 2], '["2"]', schema=mixed)["result"] == 0.0


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("a, b,,c ", ["a", "b", "c"]),
        ('["a", null, 1.0]', ["a", None, "1.0"]),
        ("[1,2", ["[1", "2"]),
        ("[1,2] x", ["[1", "2] x"]),
        ("{a,b}", ["{a", "b}"]),
        ("", []),
        (None, []),
    ],
)
def test_list_texts(spark, text, items):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(coerce.to_list(operand(df, "a")).column).first()[0] == items


def test_null_check(spark):
    row = scored(spark, "null_check", None, 1, schema="a int, b int")
    assert (row["result"]["any_null"], row["is_match"]) == (True, False)


def test_unknown_method_and_bad_pattern_are_captured(spark):
    row = scored(spark, "nope", "a", "b")
    assert row["result"] is None and "nope" in row["error"]
    assert scored(spark, "regex_match", "abc", "[a")["error"] == "invalid pattern"
    fixed = scored(spark, "regex_match", "abc", "b", {"pattern": "(("})
    assert (fixed["result"], fixed["error"]) == (None, "invalid pattern")
    with pytest.raises(ValueError, match="nope"):
        resolve_method("nope")


def test_pipeline_nulls(spark):
    texts = "a string, b string"
    assert piped(spark, "strict_equal", [("x", None), (None, None)], texts) == [(None, None)] * 2
    assert piped(spark, "normalized_equal", [("x", None)], texts) == [(None, None)]
    assert piped(spark, "boolean_logic", [("yes", None), ("no", None)], texts) == [
        (None, None),
        (False, False),
    ]
    doubles = "a double, b double"
    assert piped(spark, "null_check", [(math.nan, 1.0)], doubles)[0][0]["a_is_null"] is True
    assert piped(spark, "date_equal", [("1700000000000", "2023-11-14")], texts) == [(None, None)]


def test_aliases_swap_operands(spark):
    assert piped(spark, " diferencia ", [(10.0, 25.0)], "a double, b double")[0][0] == 15.0
    assert resolve_method("Igualdad").suffix == "igualdad"


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        ("MARTHA", "MARHTA", 0.9611),
        ("DIXON", "DICKSONX", 0.8133),
        ("DWAYNE", "DUANE", 0.84),
        ("JELLYFISH", "SMELLYFISH", 0.8963),
        ("abc", "", 0.0),
        ("", "", 1.0),
        ("abc", "xyz", 0.0),
    ],
)
def test_jaro_winkler_of_published_pairs(a, b, expected):
    assert math.isclose(jaro_winkler_text(a, b), expected, abs_tol=5e-5)


def test_jaro_winkler_has_no_order_of_letters_that_match_alone():
    rng = random.Random(3)
    for _ in range(500):
        a = "".join(rng.choices("abcd", k=rng.randint(1, 12)))
        assert jaro_winkler_text(a, a) == 1.0
        assert 0.0 <= jaro_winkler_text(a, a[::-1]) <= 1.0
        # letters that the other text lacks only lower the score
        assert jaro_winkler_text(a, a + "zzz") <= jaro_winkler_text(a, a + "z")


def test_items_of_json_arrays(spark):
    df = spark.createDataFrame(
        [
            ('[true, null, "x", 1.50, {"b": 1, "a": [2]}]', "True, None, x, 1.5"),
            ('[{"a": [2], "b": 1}, false]', '[{"b": 1, "a": [2]}, "false"]'),
            ("[not json]", "not json]"),
        ],
        "a string, b string",
    )
    x, y = operand(df, "a"), operand(df, "b")
    rows = df.select(
        evaluate(x, y, "array_intersection").alias("i"), evaluate(x, y, "array_jaccard").alias("j")
    ).collect()
    assert rows[0]["i"]["result"] == ["True", None, "x", "1.5"]
    assert rows[1]["i"]["result"] == ['{"a":[2],"b":1}']
    assert rows[2]["i"]["result"] == []
    assert [r["j"]["result"] is None for r in rows] == [True, True, False]
    assert [r["j"]["error"] is None for r in rows] == [False, False, True]


def test_common_patterns_stay_in_the_jvm_with_the_same_result(spark):
    import re

    patterns = [
        "^[a-z]+-\\d+$", "a.c", "x*y+", "(a|b)c", "[", "a{2}", "\\bword", "é+", "[^0-9]x", "a+?",
        "", "plain", "[z-a]", "a{2,1}",
    ]
    texts = ["abc-123", "axc", "aa", "word é x", "plain\n", "bc", ""]
    df = spark.createDataFrame([(t, p) for p in patterns for t in texts], "a string, b string")
    for folded in (False, True):
        found = search_column(F.col("a"), F.col("b"), folded)
        for text, pattern, got in df.select("a", "b", found).collect():
            try:
                wanted = re.search(pattern, text, re.IGNORECASE if folded else 0) is not None
            except re.error:
                wanted = None
            assert got == wanted, (text, pattern, folded)


def test_double_texts(spark):
    rng = random.Random(4)
    values = [1.0, 1e7, 9.99e15, 1e16, 1.5e300, 1e-4, 1e-5, -0.0, math.nan, math.inf, -math.inf]
    values += [round(rng.uniform(-1, 1), 12) * 10 ** rng.randint(-20, 25) for _ in range(500)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-3, 15) for _ in range(2000)]
    df = spark.createDataFrame([(value,) for value in values], "a double")
    got = df.select("a", to_text(operand(df, "a"))).collect()
    assert [text for _, text in got if len(text) < 19] == [
        repr(value) for value, text in got if len(text) < 19
    ]
    # of two texts with 16 or more digits that read back alike, Java may print the other
    for value, text in got:
        assert len(text) == len(repr(value)) and (value != value or float(text) == value)
    df = spark.createDataFrame([(None,)], "a double")
    assert df.select(to_text(operand(df, "a"))).first()[0] is None


def test_other_texts(spark):
    df = spark.sql(
        "SELECT true AS a, CAST(10.50 AS DECIMAL(9, 2)) AS b, TIMESTAMP_NTZ '2024-01-02 03:04:05.5' AS c,"
        " DATE '2024-01-02' AS d, CAST(0.1 AS FLOAT) AS e, CAST(3 AS DECIMAL(9, 2)) AS f"
    )
    texts = df.select(*[to_text(operand(df, name)).alias(name) for name in df.columns]).first()
    assert tuple(texts) == (
        "True", "10.5", "2024-01-02 03:04:05.500000", "2024-01-02", "0.1", "3.0",
    )


def test_number_texts(spark):
    texts = "1| 1.5 |1_000|1__0|_1|1d|inf|-Infinity|+nan|1e5|1e_5|.5|5.|abc||0x1|1_0.5_0".split("|")
    df = spark.createDataFrame([(text,) for text in texts], "a string")
    for text, number in df.select("a", coerce.to_float(operand(df, "a"))).collect():
        try:
            expected = float(text)
        except ValueError:
            expected = None
        assert str(number) == str(expected), text


def test_folding_and_blanks(spark):
    import re
    import unicodedata

    texts = [f" {chr(c)}A{chr(c)} \xa0" for c in range(1, 0x2100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(text,) for text in texts], "a string")
    rows = df.select("a", normalize_text(F.col("a")), squeeze_blanks(F.col("a"))).collect()
    for text, folded, squeezed in rows:
        decomposed = unicodedata.normalize("NFKD", text.strip().lower())
        assert folded == "".join(c for c in decomposed if not unicodedata.combining(c))
        assert squeezed == re.sub(r"\s+", " ", text).strip()


@pytest.mark.parametrize("seed", [1, 2])
def test_json_items_compare_by_value(spark, seed):
    rng = random.Random(seed)
    pool = [1, "1", 1.0, True, 0, False, None, "None", 2.5, "2.5", 25e-1, 10**20, 1e20, -3, "", "é", 0.1]
    rows = [
        tuple(json.dumps([rng.choice(pool) for _ in range(rng.randint(0, 6))]) for _ in range(2))
        for _ in range(80)
    ]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = operand(df, "a"), operand(df, "b")
    got = df.select(
        "a", "b",
        evaluate(a, b, "array_difference")["result"].alias("only"),
        evaluate(a, b, "array_jaccard")["result"].alias("shared"),
    )
    for row in got.collect():
        x, y = json.loads(row["a"]), json.loads(row["b"])
        only = []
        for item in x:
            if item not in y and item not in only:
                only.append(item)
        assert len(row["only"]) == len(only)
        texts = [i if i is None or isinstance(i, str) else str(i) for i in only]
        small = [isinstance(i, str) or abs(i or 0) < 1e15 for i in only]  # others may read 1E20
        assert [t for t, s in zip(row["only"], small, strict=True) if s] == [
            t for t, s in zip(texts, small, strict=True) if s
        ]
        union = set(x) | set(y)
        assert row["shared"] == (len(set(x) & set(y)) / len(union) if union else 1.0)


def test_json_numbers_meet_typed_numbers(spark):
    df = spark.createDataFrame([("[1, \"2\", 3.5, true]", [1, 2], [3.5])], "a string, b array<int>, c array<double>")
    a, b, c = (operand(df, n) for n in "abc")
    row = df.select(
        evaluate(a, b, "array_difference")["result"].alias("ab"),
        evaluate(b, a, "array_difference")["result"].alias("ba"),
        evaluate(a, c, "array_jaccard")["result"].alias("ac"),
    ).first()
    assert (row["ab"], row["ba"], row["ac"]) == (["2", "3.5"], [2], 1 / 3)


def test_shared_patterns_need_no_python(spark):
    rows = [("ab12", "^a.1"), ("ab12", "b[0-9]{2}$"), ("AB", "ab"), ("ab", "(?<=a)b"), ("ab", "[")]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = operand(df, "a"), operand(df, "b")
    found = df.select(evaluate(a, b, "regex_match", {"dialect": "shared"})["result"].alias("r"))
    assert [r["r"] for r in found.collect()] == [True, True, False, None, None]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    both = df.select(evaluate(a, b, "regex_match")["result"].alias("r"))
    assert [r["r"] for r in both.collect()] == [True, True, False, True, None]
