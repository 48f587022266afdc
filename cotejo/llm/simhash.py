"""SimHash near-duplicates by generalised pigeonhole search.

Bits are grouped into partitions, correlated ones together. With m partitions of thresholds that
add up to ``bits - m + 1``, any two fingerprints at most ``bits`` apart are within the threshold
in some partition. The thresholds (and m) come from dynamic programming on the candidate counts
that the bit frequencies of all fingerprints let expect. Each fingerprint is filed once for every
way to blank as many bits of a partition as its threshold says; those filed alike are compared,
which verifies the whole fingerprint.

Documents of one fingerprint are folded first. A bucket with more than ``BLOCK`` fingerprints is
dealt into blocks, and pairs of blocks are compared in tasks of their own. Of the links a fingerprint
has to smaller ones filed alike, those go that its link to the smallest of them makes superfluous, so
n fingerprints all near each other give n - 1 links. All of this is SQL; fingerprints are computed by
row in Python, or by ``text_fingerprints`` in SQL where a job may not run Python.

Defined results: a text with fewer words than a shingle is one shingle; a NULL text or one without
words has the fingerprint zero, which is linked like any other; NULL ids are never the smallest of
a group; repeated rows share their group; an empty table gives no rows. A long text is hashed whole,
in one row's memory. Names of input columns are free: groups are found on renamed copies of the id
and the text, and a column that is added replaces one of its name in any case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.llm.common import (
    LOWER,
    SPACE,
    SPACE_PATTERN,
    UPPER,
    ascii_lower,
    let,
    row_key,
    stored,
    text_hash,
    text_of,
    with_columns,
)
from cotejo.llm.components import components

WIDTH = 64
BLOCK = 2048
#: Work of filing a fingerprint once, in comparisons of two fingerprints.
FILING = 20.0
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str, size: int) -> int:
    """Majority bits of the 64-bit hashes of all shingles of that many words."""
    words = text.encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = starts[min(size, len(words)) :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends, strict=False)], np.uint64
    )
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * ones.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 4, text_col: str = "text") -> DataFrame:
    """Adds ``simhash``, the 64 bits as a signed long; the text column goes."""
    source = with_columns(docs, _text=text_of(text_col))
    if text_col != "_text":
        source = source.drop(text_col)
    rest = [f for f in source.schema.fields if f.name.lower() not in ("_text", "simhash")]
    out = T.StructType([*rest, T.StructField("simhash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, size) for x in batch.column("_text").to_pylist()]
            columns = [batch.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, pa.int64())], names=[f.name for f in out.fields]
            )

    return source.select(*[f"`{f.name}`" for f in rest], "_text").mapInArrow(run, out)


def _bit(value: Column, i: int) -> Column:
    return F.shiftrightunsigned(value, i).bitwiseAND(F.lit(1))


def text_fingerprints(docs: DataFrame, size: int = 4, text_col: str = "text") -> DataFrame:
    """``key`` (see row_key) and ``simhash`` of every different text, without Python.

    Shingles are counted bit by bit under the text's key, so equal texts add up to one row, with the
    same majorities; what is shuffled are the counts of a text, not its shingles.
    """
    text = text_of(text_col)
    inner = F.btrim(ascii_lower(text), F.lit(SPACE))
    # exploded, so that later steps do not split the text again
    split = F.explode(F.array(F.split("inner", SPACE_PATTERN, -1))).alias("words")
    words = docs.select(row_key(text).alias("key"), inner.alias("inner")).select("key", split)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    shingle = F.concat_ws(" ", *[F.get("words", F.col("at") + i) for i in range(size)])
    # a text without words gives one empty word
    value = F.when(F.get("words", F.lit(0)) == "", F.lit(0)).otherwise(F.xxhash64(shingle))
    hashes = words.select("key", "words", F.explode(starts).alias("at")).select(
        F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2"), value.alias("h")
    )
    ones = [F.sum(_bit(F.col("h"), i)).alias(f"b{i}") for i in range(WIDTH)]
    counted = hashes.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), *ones)
    # folded over an array: 64 conditions in a row would be more code than the JVM compiles
    bits = F.transform(
        F.array(*[f"b{i}" for i in reversed(range(WIDTH))]),
        lambda b: (2 * b > F.col("n")).cast("long"),
    )
    simhash = F.aggregate(
        bits, F.lit(0).cast("long"), lambda found, b: F.shiftleft(found, 1).bitwiseOR(b)
    )
    return counted.select(F.struct("k1", "k2").alias("key"), simhash.alias("simhash"))


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for every two bits how often both are set; over all rows."""
    half = WIDTH // 2
    turned = prints.select(
        "simhash", F.explode(F.sequence(F.lit(0), F.lit(half))).alias("turn")
    ).select(
        "turn",
        F.expr(
            f"simhash & (shiftrightunsigned(simhash, turn) | shiftleft(simhash, {WIDTH} - turn))"
        ).alias("both"),
    )
    sums = [F.sum(_bit(F.col("both"), i)).alias(f"b{i}") for i in range(WIDTH)]
    rows = turned.groupBy("turn").agg(F.count(F.lit(1)).alias("n"), *sums).collect()  # 33 rows
    both = np.zeros((WIDTH, WIDTH))
    bits = np.arange(WIDTH)
    for row in rows:
        other = (bits + row["turn"]) % WIDTH
        both[bits, other] = both[other, bits] = row[2:]
    return (rows[0]["n"] if rows else 0), both


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of even size, each grown by the bit most correlated with it."""
    share = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    linked = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(linked, 0)
    left, groups = list(range(WIDTH)), []
    for i in range(m):
        size = len(left) // (m - i)
        group = [max(left, key=lambda b: (linked[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (linked[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _cost(n: int, differ: np.ndarray, threshold: int) -> float:
    """Expected work of a partition: filing, and comparisons of fingerprints filed alike."""
    if threshold < 0:
        return 0.0
    apart = np.array([1.0])  # share of pairs with 0, 1, ... different bits in the partition
    for p in differ:
        apart = np.convolve(apart, [1 - p, p])
    w = len(differ)
    met = sum(apart[k] * comb(w - k, threshold - k) for k in range(min(threshold, w) + 1))
    return FILING * n * comb(w, threshold) + n * n / 2 * met


def allocate(n: int, both: np.ndarray, bits: int) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds, at least expected cost; those of -1 are left out.

    No fingerprints need no plan: every cost would be zero, that of a plan with most masks included.
    """
    if not n:
        return []
    share = both.diagonal() / max(n, 1)
    differ = 2 * share * (1 - share)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, bits + 3):
        groups = correlated_groups(n, both, m)
        # cheapest thresholds of the groups so far, by their sum
        reached: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for group in groups:
            costs = {
                t: _cost(n, differ[group], t) for t in range(-1, min(bits, len(group)) + 1)
            }
            following: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (cost, chosen) in reached.items():
                for t, more in costs.items():
                    option = (cost + more, (*chosen, t))
                    if total + t not in following or option < following[total + t]:
                        following[total + t] = option
            reached = following
        option = reached.get(bits - m + 1)
        if option and option[0] < best[0]:
            best = (option[0], [(g, t) for g, t in zip(groups, option[1], strict=True) if t >= 0])
    return best[1]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """The bits looked at by each way of filing."""
    masks = []
    for group, threshold in plan:
        whole = sum(1 << b for b in group)
        masks += [
            _signed(whole & ~sum(1 << b for b in blank)) for blank in combinations(group, threshold)
        ]
    return masks


def links(prints: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` that connect distinct fingerprints as all pairs within ``bits`` would."""
    n, both = bit_statistics(prints)
    plan = allocate(n, both, bits)
    filed = prints.select(
        "simhash",
        F.posexplode(
            F.array(*[F.col("simhash").bitwiseAND(F.lit(mask)) for mask in _masks(plan)])
            if plan
            else F.array().cast("array<bigint>")
        ).alias("way", "value"),
    )
    shared = (
        filed.groupBy("way", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("way", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("simhash"), F.col("blocks")).cast("int")

    def pair(j: Column) -> Column:
        return F.struct(F.least(own, j).alias("p"), F.greatest(own, j).alias("q"))

    at = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)
    keys = ["way", "value", "p", "q"]
    dealt = (
        filed.join(shared, ["way", "value"])
        .select("way", "value", "simhash", F.explode(at).alias("at"))
        .select("way", "value", F.col("at.p").alias("p"), F.col("at.q").alias("q"), "simhash")
    )
    alike = (
        dealt.repartition(*keys)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("simhash")).alias("alike"))
        .select("alike", F.posexplode("alike").alias("pos", "a"))
    )

    def near(other: Column) -> Callable[[Column], Column]:
        return lambda x: F.bit_count(x.bitwiseXOR(other)) <= bits

    def needed(found: Column) -> Column:
        # the link to a third, smaller fingerprint that both are near makes a link superfluous
        least = F.get(found, F.lit(0))
        return F.filter(found, lambda x: (x == least) | ~near(least)(x))

    smaller = F.filter(F.slice("alike", F.lit(1), F.col("pos")), near(F.col("a")))
    return alike.select("a", F.explode(let(smaller, needed)).alias("b")).distinct()


def _rooted(nodes: DataFrame, bits: int, block: int) -> DataFrame:
    """The rows of ``nodes``, one per fingerprint, with the ``root`` of their group."""
    roots = components(links(nodes, bits, block))
    return nodes.join(roots, nodes["simhash"] == roots["node"], "left").select(
        *[nodes[c] for c in nodes.columns], F.coalesce("root", "simhash").alias("root")
    )


def simhash_groups(
    docs: DataFrame,
    size: int = 4,
    bits: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: the id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``,
    the smallest id that links of at most ``bits`` different bits reach."""
    ids = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marked = stored(fingerprints(ids, size, "_text"), "simhash")
    nodes = stored(
        marked.groupBy("simhash").agg(F.min("_id").alias("least")), "simhash-nodes"
    )
    rooted = _rooted(nodes, bits, block)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("simhash", "component_id")
    return marked.join(named, "simhash", "left").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def with_group(
    docs: DataFrame,
    group_col: str,
    size: int = 4,
    bits: int = 4,
    text_col: str = "text",
) -> DataFrame:
    """Adds the root fingerprint of each row's group, the same for all near copies of a text; without
    Python. Texts move once, to the fingerprints of their keys."""
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = stored(text_fingerprints(docs, size, text_col), "simhash")
    nodes = stored(marked.select("simhash").distinct(), "simhash-nodes")
    roots = components(links(nodes, bits)).where("node <> root")
    grouped = marked.join(stored(roots, "roots"), marked["simhash"] == F.col("node"), "left").select(
        "key", F.coalesce("root", "simhash").alias("group")
    )
    keyed = docs.select(rows, row_key(text_of(text_col)).alias("key"))
    joined = keyed.join(stored(grouped, "groups"), "key")
    rest = [c for c in docs.columns if c.lower() != group_col.lower()]
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in rest], F.col("group").alias(group_col)
    )


def near_dedup(
    docs: DataFrame,
    size: int = 4,
    bits: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Of each group the document with the smallest id; a text's hash decides between equal ids, and
    NULL ids come last. Rows that repeat both the id and the text of a survivor count as it."""
    ids = docs.select(
        F.col(id_col).alias("_id"),
        text_hash(text_of(text_col)).alias("_hash"),
        F.col(text_col).alias("_text"),
    )
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_hash")).alias("first")
    marked = stored(fingerprints(ids, size, "_text"), "simhash")
    nodes = stored(marked.groupBy("simhash").agg(first), "simhash-nodes")
    kept = (
        _rooted(nodes, bits, BLOCK)
        .groupBy("root")
        .agg(F.min("first").alias("first"))
        .select(F.col("first._id").alias("_kept_id"), F.col("first._hash").alias("_kept_hash"))
    )
    return _survivors(docs, kept, id_col, text_col)


def _survivors(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of the ids and text hashes in ``kept``, one of each."""
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    hashed = docs.select(
        rows, F.col(id_col).alias("id"), text_hash(text_of(text_col)).alias("hash")
    )
    same = (F.col("hash") == F.col("_kept_hash")) & F.col("id").eqNullSafe(F.col("_kept_id"))
    found = hashed.join(kept, same, "left_semi").dropDuplicates(["id", "hash"])
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
