"""Benchmark decontamination with a broadcast set of normalised n-grams, in native expressions.

Benchmark texts are cut into windows of ``size`` words (an item with fewer words is one window).
Every window of every document is hashed and probed against the hashes of these windows; hits are
verified on the words themselves, and the covered words are removed, or the documents that hold
them. The set is broadcast if its exact number of (window, item) rows is at most ``broadcast_rows``;
a larger one is joined by a shuffle, with the same result.

Defined results: a NULL text has no words and is clean; items without words are ignored; equal
documents are looked up once and judged alike; empty tables on either side give no hits; a column
of the input that has the name of a result column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import ascii_lower, let, row_key, text_of

#: What stands between words once A-Z is in lower case, and a word before that.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000


def benchmark_words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return F.filter(F.split(ascii_lower(text), GAPS, -1), lambda w: w != "")


def _starts(words: Column, size: Column) -> Column:
    """Positions at which a window of that many words begins."""
    last = F.size(words) - size
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(
        F.array().cast("array<int>")
    )


def benchmark_windows(items: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """The distinct windows: ``size`` (words), ``window`` (joined words) and ``items`` (ids)."""
    width = F.least(F.lit(size), F.size("words"))
    return (
        items.select(
            F.col(item_col).alias("item"), benchmark_words(text_of(text_col)).alias("words")
        )
        .where(F.size("words") > 0)
        .select(
            "item",
            width.alias("size"),
            F.explode(
                F.transform(
                    _starts(F.col("words"), width),
                    lambda i: F.array_join(F.slice(F.col("words"), i + 1, width), " "),
                )
            ).alias("window"),
        )
        .groupBy("size", "window")
        .agg(F.collect_set("item").alias("items"), F.count(F.lit(1)).alias("n"))
    )


def find_windows(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Hits by document text: ``_key``, ``_hits`` (pos, size, window) and ``_windows``."""
    windows = benchmark_windows(items, size, item_col, item_text_col).withColumn(
        "h", F.xxhash64(F.split("window", " "))
    )
    # at most `size` different lengths, one row of sums
    facts = windows.agg(
        F.collect_set("size").alias("sizes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")
    ).first()
    if facts["rows"] <= broadcast_rows:
        windows = F.broadcast(windows)

    def probes(words: Column) -> Column:
        def of_size(n: Column) -> Column:
            return F.transform(
                _starts(words, n),
                lambda i: F.struct(
                    i.alias("pos"),
                    n.alias("size"),
                    F.xxhash64(F.slice(words, i + 1, n)).alias("h"),
                ),
            )

        by_size = [of_size(F.lit(n)) for n in sorted(facts["sizes"])]
        return F.concat(*by_size) if len(by_size) > 1 else by_size[0]

    if not facts["sizes"]:
        nothing = "array<struct<pos:int,size:int,h:bigint>>"
        probed = F.array().cast(nothing)
    else:
        probed = let(benchmark_words(text_of(text_col)), probes)
    return (
        docs.select(row_key(text_of(text_col)).alias("_key"), F.explode(probed).alias("p"))
        .select("_key", F.col("p.pos").alias("pos"), F.col("p.size").alias("size"), "p.h")
        .join(windows.drop("n"), ["size", "h"])
        .groupBy("_key")
        .agg(
            F.collect_set(F.struct("pos", "size", "window")).alias("_hits"),
            F.collect_set(F.struct("window", "items")).alias("_windows"),
        )
    )


def _covered(hits: Column) -> Column:
    """Number of words inside any of the hits, which are sorted by position."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(total: Column, hit: Column) -> Column:
        end = hit["pos"] + hit["size"]
        new = F.greatest(F.lit(0), end - F.greatest(hit["pos"], total["end"]))
        return F.struct(
            (total["n"] + new).alias("n"), F.greatest(total["end"], end).alias("end")
        )

    return F.aggregate(hits, zero, add, lambda total: total["n"])


def _without(text: Column, hits: Column) -> Column:
    """The text without the words inside hits and what follows each of them up to the next word."""

    def cut(parts: Column) -> Column:
        words, gaps = parts["words"], parts["gaps"]
        covered = F.flatten(
            F.transform(hits, lambda x: F.sequence(x["pos"], x["pos"] + x["size"] - 1))
        )
        left = F.array_except(F.sequence(F.lit(0), F.size(words) - 1), covered)
        return F.concat(
            F.get(gaps, F.lit(0)),
            F.array_join(
                F.transform(left, lambda i: F.concat(F.get(words, i), F.get(gaps, i + 1))), ""
            ),
        )

    return let(
        F.struct(
            F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)).alias("words"),
            F.split(text, RAW_WORD, -1).alias("gaps"),
        ),
        cut,
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Adds n_words, n_hit, ``item_ids`` (of items with occurring windows), contaminated and
    ``clean_text`` (without the covered words)."""
    found = find_windows(docs, items, size, text_col, item_col, item_text_col, broadcast_rows)
    text = F.col("text")
    item_type = items.schema[item_col].dataType.simpleString()

    def judged(words: Column) -> Column:
        def true_hit(x: Column) -> Column:
            return F.array_join(F.slice(words, x["pos"] + 1, x["size"]), " ") == x["window"]

        def summed(hits: Column) -> Column:
            true_windows = F.when(F.size(hits) == F.size("hits"), F.col("windows")).otherwise(
                F.filter(
                    F.col("windows"),
                    lambda w: F.exists(hits, lambda x: x["window"] == w["window"]),
                )
            )
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                _covered(hits).cast("long").alias("n_hit"),
                F.array_distinct(F.flatten(F.transform(true_windows, lambda w: w["items"]))).alias(
                    "item_ids"
                ),
                F.when(F.size(hits) > 0, _without(text, hits)).otherwise(text).alias("clean_text"),
            )

        found_here = F.when(
            F.col("hits").isNull(),
            F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.lit(0).cast("long").alias("n_hit"),
                F.array().cast(f"array<{item_type}>").alias("item_ids"),
                text.alias("clean_text"),
            ),
        )
        return found_here.otherwise(
            let(F.array_sort(F.filter(F.col("hits"), true_hit)), summed)
        )

    # the document's own columns travel as one, so that none of their names can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, text_of(text_col).alias("text"), row_key(text_of(text_col)).alias("key"))
    hits = found.select(
        F.col("_key").alias("key"), F.col("_hits").alias("hits"), F.col("_windows").alias("windows")
    )
    result = keyed.join(hits, "key", "left").select(
        "row", let(benchmark_words(text), judged).alias("judged")
    )
    figures = {
        name: F.col("judged")[name] for name in ("n_words", "n_hit", "item_ids", "clean_text")
    }
    figures["contaminated"] = F.col("judged")["n_hit"] > 0
    rest = [c for c in docs.columns if c.lower() not in figures]
    return result.select(
        *[F.col("row").getField(c).alias(c) for c in rest],
        *[value.alias(name) for name, value in figures.items()],
    )
