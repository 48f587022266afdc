"""Regular-expression search with a fixed or a per-row pattern."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = r"[\\.^$*+?{}\[\]|()]"

#: Patterns that are valid in both dialects and mean the same: a row of characters, classes and
#: escapes, each with one quantifier at most, between optional anchors.
_ATOM = (
    r"(?:[\w\s@#%&=<>!~'\",:;/-]|\.|\\[dwsDWS.\\+*?()\[\]{}|^$/-]"
    r"|\[\^?(?:a-z|A-Z|0-9|[\w.,:;@/+ ])+-?\])"
)
COMMON = rf"^\^?(?:{_ATOM}(?:[*+?]|\{{\d{{1,3}},?\}})?)*\$?$"


def pattern_error(pattern: str) -> str | None:
    try:
        re.compile(pattern)
    except re.error as problem:
        return str(problem)
    return None


def search_fixed(text: Column, pattern: str, ignore_case: bool) -> Column:
    """Search for one known pattern; NULL when it is no valid expression."""
    if pattern_error(pattern):
        return F.lit(None).cast("boolean")
    if re.fullmatch(r"[\w\s\-+*?.^$\[\]\\|(){},:;/@#%&=<>!~'\"]*", pattern, re.ASCII) and not re.search(
        r"\(\?P|\\[AZzGQEpPhHvVRXkKNuUxc0-9]|&&|\[[^\]]*\[|\(\?\(", pattern
    ):
        # the dialects agree on this subset; U and d give the letter classes and line ends
        return text.rlike(("(?dUui)" if ignore_case else "(?dU)") + pattern)
    return _search_batch(text, F.lit(pattern), F.lit(ignore_case))


def search_column(
    text: Column, pattern: Column, ignore_case: bool, shared_only: bool = False
) -> Column:
    """Search for each row's own pattern; NULL where it is no valid expression.

    Patterns without special characters are plain text searches, and common ones mean the same
    in the JVM; only the others go to Python. With ``shared_only`` there is no Python in the plan:
    those others give NULL, as an expression that is not understood.
    """
    plain = ~pattern.rlike(META) & F.lit(not ignore_case)
    common = pattern.rlike(COMMON) & ~pattern.contains("\n")
    other = ~plain & ~common
    if shared_only:
        searched = F.lit(None).cast("boolean")
    else:
        searched = _search_batch(F.when(other, text), F.when(other, pattern), F.lit(ignore_case))
    prefix = F.lit("(?dUui)" if ignore_case else "(?dU)")
    # a pattern of another kind never reaches the JVM's compiler
    own = F.concat(prefix, F.when(common, pattern).otherwise(F.lit("")))
    return (
        F.when(plain, text.contains(pattern))
        .when(common, F.rlike(text, own))
        .otherwise(searched)
    )


@F.pandas_udf(T.BooleanType())
def _search_batch(texts: pd.Series, patterns: pd.Series, ignore_case: pd.Series) -> pd.Series:
    compiled: dict[tuple[str, bool], re.Pattern[str] | None] = {}
    found: list[bool | None] = []
    for text, pattern, folded in zip(texts, patterns, ignore_case):
        if pattern is None or text is None:
            found.append(None)
            continue
        key = (pattern, bool(folded))
        if key not in compiled:
            try:
                compiled[key] = re.compile(pattern, re.IGNORECASE if folded else 0)
            except re.error:
                compiled[key] = None
        expression = compiled[key]
        found.append(None if expression is None else expression.search(text) is not None)
    return pd.Series(found, dtype="object")
