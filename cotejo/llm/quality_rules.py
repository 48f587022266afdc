"""Line-first quality rules in native expressions.

Every line is judged first: headings and menu entries without closing punctuation, symbol noise,
shouting, navigation bars and boilerplate fail. Failing lines are removed, and a document that
loses too many of its words with them is rejected, as is one that is too short or repeats itself.
One pass over the table, no shuffle.

Defined results: a NULL text counts as empty, has no words and is rejected; empty lines are kept
and never judged; repeated rows are judged alike; an empty table gives no rows; a column of the
input that has the name of a result column is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import SPACE, let, space_words, text_of, with_columns

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»·•"
CLOSING = r"""[.!?…:;,"'”’»)\]]$"""
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share this",
    "sign in",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; the defaults are the production values."""

    heading_words: int = 10
    symbols_per_word: float = 0.5
    shouts_per_word: float = 0.5
    separators: int = 3
    separators_per_word: float = 0.25
    boilerplate_words: int = 30
    min_kept_share: float = 0.5
    min_words: int = 50
    max_repeat_share: float = 0.5


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_passes(line: Column, n_words: Column, rules: Rules) -> Column:
    """Whether a line with that many words passes; a line without words does."""
    inner = F.btrim(line, F.lit(SPACE))
    unclosed = (n_words < rules.heading_words) & ~inner.rlike(CLOSING)
    noisy = _count_of(inner, SYMBOLS) > n_words * F.lit(rules.symbols_per_word)
    shouting = F.regexp_count(inner, F.lit(r"[!?]{2,}")) > n_words * F.lit(rules.shouts_per_word)
    bars = _count_of(inner, SEPARATORS)
    navigation = (bars >= rules.separators) & (bars >= n_words * F.lit(rules.separators_per_word))
    boilerplate = (n_words <= rules.boilerplate_words) & F.lower(inner).rlike(
        "|".join(BOILERPLATE)
    )
    return (n_words == 0) | ~(unclosed | noisy | shouting | navigation | boilerplate)


def repeat_words(words: Column) -> Column:
    """Number of words inside three-word windows that are found at least twice.

    Windows are sorted by their hash within the document, so the work is n log n for any text.
    """

    def covered(positions: Column) -> Column:
        reach = F.transform(
            positions,
            lambda p, i: F.least(F.lit(3), F.coalesce(F.get(positions, i + 1) - p, F.lit(3))),
        )
        return F.aggregate(reach, F.lit(0), lambda total, x: total + x)

    def repeated(placed: Column) -> Column:
        def twin(x: Column, at: Column) -> Column:
            return F.coalesce(F.get(placed, at)["h"] == x["h"], F.lit(False))

        return F.filter(placed, lambda x, i: twin(x, i - 1) | twin(x, i + 1))

    def of_windows(windows: Column) -> Column:
        placed = F.array_sort(
            F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )
        positions = let(
            placed, lambda p: F.array_sort(F.transform(repeated(p), lambda x: x["i"]))
        )
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            let(positions, covered)
        )

    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(n < 3, F.lit(0)).otherwise(let(windows, of_windows))


def _word_figures(text: Column) -> Column:
    return let(
        space_words(text),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0), lambda total, w: total + F.length(w))
            .cast("long")
            .alias("word_chars"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
        ),
    )


def _line_figures(text: Column, rules: Rules) -> Column:
    def judged(line: Column) -> Column:
        return let(
            F.size(space_words(line)),
            lambda n: F.struct(
                line.alias("line"), n.alias("n"), line_passes(line, n, rules).alias("ok")
            ),
        )

    def figures(lines: Column) -> Column:
        worded = F.transform(F.filter(lines, lambda x: x["n"] > 0), lambda x: x["line"])
        passed = F.filter(lines, lambda x: x["ok"])
        return F.struct(
            (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(passed).cast("long").alias("n_lines_kept"),
            F.aggregate(passed, F.lit(0), lambda total, x: total + x["n"])
            .cast("long")
            .alias("n_words_kept"),
            F.array_join(F.transform(passed, lambda x: x["line"]), "\n").alias("clean_text"),
        )

    return let(F.transform(F.split(text, "\n", -1), judged), figures)


def quality_rules(
    docs: DataFrame, text_col: str = "text", rules: Rules | None = None
) -> DataFrame:
    """Adds the counts, ``clean_text`` (the passing lines), ``base_failed`` and ``kept``."""
    rules = rules or Rules()
    text = text_of(text_col)
    measured = with_columns(
        docs,
        _words=_word_figures(text),
        _lines=_line_figures(text, rules),
        n_symbols=_count_of(text, SYMBOLS).cast("long"),
    )
    words, lines = F.col("_words"), F.col("_lines")
    n_words = words["n_words"]
    base_failed = (n_words < rules.min_words) | (
        words["n_repeat_words"] > n_words * F.lit(rules.max_repeat_share)
    )
    kept = ~base_failed & (lines["n_words_kept"] >= n_words * F.lit(rules.min_kept_share))
    figures = {name: words[name] for name in ("n_words", "word_chars", "n_repeat_words")}
    figures |= {
        name: lines[name]
        for name in ("n_dup_lines", "n_lines", "n_lines_kept", "n_words_kept", "clean_text")
    }
    return with_columns(measured, **figures, base_failed=base_failed, kept=kept).drop(
        "_words", "_lines"
    )
