"""Words grouped with the frequent word that they differ from by one letter.

Words are found and counted by DataFrame functions. Those of one length that no task should search
alone are parted by a k-d tree over their letter counts, whose splits come from a sample of at most
about ``SAMPLE`` words (they decide how even the parts are, not what is found). Every word goes to
its part, and as a question to each part, of its own length and of one more, whose box it can reach
by one edit. A task builds the k-d tree of one part after the other and puts the questions to it in
batches; words that pass the boxes are compared letter by letter. So every pair of words one edit
apart is met once from either side, without any group being paired with itself.

Results in the odd cases: a NULL text has no words, a NULL id counts as the empty text where damage is
chosen; repeated rows count again; of several most frequent neighbours the first in code point order
is taken; an empty table gives an empty table; other columns are not looked at. Words may be of
any length: a part holds fewer of long ones.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import ascii_lower, stored, text_of
from cotejo.llm.count_trees import Splits, Tree, codes_of, letters_of, points_of

#: Words, about, that the driver gets to place the splits of all lengths.
SAMPLE = 1 << 16
#: Code points of the words of a part, about.
PART_CHARS = 1 << 17
#: Splits of one length, at most.
DEPTH = 13
ASKED = 1 << 13


def word_counts(
    docs: DataFrame,
    min_chars: int = 7,
    min_count: int = 2,
    damage: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """word, n: runs of Latin letters of at least ``min_chars`` code points, found at least
    ``min_count`` times; A-Z in lower case.

    With ``damage`` a run loses a letter if the CRC-32 h of ``<id>:<run>`` is a multiple of it: the
    letter at h modulo the run's length. That plants misspellings whose right form is known.
    """
    runs = F.regexp_extract_all(text_of(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{min_chars},}}"), 0)
    found = docs.select(text_of(id_col).alias("_id"), F.explode(runs).alias("_run"))
    found = found.select("_id", ascii_lower(F.col("_run")).alias("word"))
    if damage:
        h, size = F.crc32(F.concat_ws(":", "_id", "word").cast("binary")), F.length("word")
        at = (F.col("_h") % size).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, size))
        word = F.when(F.col("_h") % damage == 0, cut).otherwise(F.col("word"))
        found = found.withColumn("_h", h).select(word.alias("word"))
        found = found.where(F.length("word") >= min_chars)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def part_splits(words: DataFrame, part_chars: int = PART_CHARS) -> tuple[dict[int, Splits], int]:
    """Splits of the lengths that need more than one part, and about how many parts there are."""
    size = F.length("word")
    lengths = words.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"))
    per_part = F.greatest(F.lit(part_chars) / F.col("size"), F.lit(1))
    lengths = lengths.withColumn("parts", F.ceil(F.col("n") / per_part))
    total = int(lengths.agg(F.sum("parts")).first()[0] or 0)
    large = {r["size"]: r["parts"] for r in lengths.where("parts > 1").collect()}
    if not large:
        return {}, total
    count = words.where(size.isin(list(large))).count()
    share = min(1.0, SAMPLE / count)
    chosen = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample: dict[int, list[str]] = {}
    for row in words.where(size.isin(list(large)) & chosen).select("word").toLocalIterator():
        sample.setdefault(len(row["word"]), []).append(row["word"])
    splits = {}
    for length, found in sample.items():
        depth = min(DEPTH, math.ceil(math.log2(large[length])))
        splits[length] = Splits(points_of(letters_of(sorted(found))), depth)
    return splits, total


def _routed(words: DataFrame, splits: dict[int, Splits]) -> DataFrame:
    """Every word as a member (role 0) of its part and as a question to the parts in reach: of its
    own length (1) and of one letter more (2)."""
    shared = words.sparkSession.sparkContext.broadcast(pickle.dumps(splits))  # 2**DEPTH a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, Splits] = pickle.loads(shared.value)
        boxes = {length: tree.boxes() for length, tree in trees.items()}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            for length in np.unique(sizes):
                rows = np.flatnonzero(sizes == length)
                points = points_of(letters_of([texts[i] for i in rows]))
                own = trees[length].leaf_of(points) if length in trees else np.zeros(len(rows), int)
                found = [(np.arange(len(rows)), own, length, 0)]
                for role, target in ((1, length), (2, length + 1)):
                    if target in boxes:
                        who, leaf = boxes[target].near(codes_of(points), 2 - role)
                    else:
                        who, leaf = np.arange(len(rows)), np.zeros(len(rows), int)
                    found.append((who, leaf, target, role))
                for who, leaf, target, role in found:
                    sent = batch.take(pa.array(rows[who]))
                    part = pa.array((np.int64(target) << DEPTH) | leaf.astype(np.int64))
                    roles = pa.array(np.full(len(who), role, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [part, roles, *sent.columns], names=["part", "role", "word", "n"]
                    )

    return words.select("word", "n").mapInArrow(run, "part long, role int, word string, n long")


def near_words(words: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """word, near, near_n: every ordered pair of words one inserted, deleted or replaced code point
    apart. ``words`` (word, n) must be written, not computed anew for each use."""
    splits, parts = part_splits(words, part_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, members, counts, tree = -1, [], [], None
        for batch in batches:
            ids, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, ns = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            turns = np.flatnonzero((np.diff(ids) != 0) | (np.diff(roles) != 0)) + 1
            steps = np.arange(0, len(ids), ASKED)
            edges = np.unique(np.concatenate([turns, steps, [0, len(ids)]]))
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if ids[start] != part:
                    part, members, counts, tree = ids[start], [], [], None
                if roles[start] == 0:
                    members += texts[start:stop]
                    counts.append(ns[start:stop])
                    continue
                if not members:
                    continue
                if tree is None:
                    tree, own_n = Tree(members), np.concatenate(counts)
                who, at = tree.near(letters_of(texts[start:stop]))
                asked = [texts[start + i] for i in who]
                found = [members[i] for i in at]
                found_n = own_n[at]
                if roles[start] == 2:  # the members do not ask for shorter words
                    asked, found = asked + found, found + asked
                    found_n = np.concatenate([found_n, ns[start + who]])
                columns = [pa.array(asked, pa.string()), pa.array(found, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(found_n)], names=["word", "near", "near_n"]
                )

    dealt = _routed(words, splits).repartition(max(1, 2 * parts), "part")
    return dealt.sortWithinPartitions("part", "role").mapInArrow(
        run, "word string, near string, near_n long"
    )


def spelling_variants(
    words: DataFrame, ratio: int = 10, part_chars: int = PART_CHARS
) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of different words and their counts.

    ``form`` is the most frequent near word if it is found ``ratio`` times as often as the word, else
    NULL; ``root`` is the end of the chain of forms, the word itself where it has none.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its variants")
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_words(words, part_chars)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct(-F.col("near_n"), F.col("near"))))
    grouped = (
        words.unionByName(pairs, allowMissingColumns=True)
        .groupBy("word")
        .agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("_best"))
    )
    form_n = -F.col("_best")["col1"]
    chosen = form_n >= ratio * F.col("n")
    formed = stored(
        grouped.select(
            "word",
            F.when(chosen, F.col("_best")["near"]).alias("form"),
            "n",
            "n_near",
            F.when(chosen, form_n).alias("form_n"),
        ),
        "forms",
    )
    # a chain has no more steps than the greatest count allows; each round doubles what is followed
    top, least = words.agg(F.max("n"), F.min("n")).first()
    steps = int(math.log(top / max(1, least), ratio) + 1) if top else 1
    root = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        ahead = root.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        root = root.join(ahead, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root")
        )
        root = stored(root, "roots")
    return formed.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
