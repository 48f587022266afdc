"""Removing long repeated substrings by two-stage suffix sorting.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else as well. Equal
windows of that length have the same content-defined anchor, so windows are compared only within
the group of their anchor's bytes. Three passes over the texts:

1. Count the blocks (runs of windows with one anchor) and the different ones among them by the
   anchor's hash. A group of one block repeats nothing; in a group of equal blocks all windows do.
2. Of groups with different blocks, send each different block once to the group's task. There the
   suffixes that begin windows are sorted in two stages, the common prefixes of neighbours are
   computed, and those of ``length`` bytes repeat. A group of more than ``GROUP`` different blocks
   is dealt into parts; classes of its parts meet again by a hash of their window.
3. Look the groups and blocks up and cut the covered bytes out of the texts.

What the passes share are sorted arrays in the shared folder, memory-mapped by the workers; texts
are never shuffled, apart from the blocks of pass 2.

Defined results: NULL counts as empty; texts shorter than ``length`` keep all; equal texts repeat
each other; an empty table gives no rows; a column of the input that has the name of a result
column, in any case, is replaced by it; long texts are handled whole, one at a time beyond PIECE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.llm.anchors import blocks
from cotejo.llm.arrays import find_sorted, place_of, write_sorted
from cotejo.llm.common import scratch_folder, stored, text_of, with_columns
from cotejo.llm.suffix_sort import classes, sorted_starts

LENGTH = 400
#: Blocks of a group that one task sorts, blocks sorted at a time, bytes of text handled at a time.
GROUP = 4096
CHUNK = 2048
PIECE = 1 << 20
SHARD_DOCS = 1 << 14


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as bytes in runs of about PIECE bytes, with the number of the first."""
    held: list[bytes] = []
    start, size = 0, 0
    for number, text in enumerate(texts):
        held.append(text.encode("utf-8"))
        size += len(held[-1])
        if size >= PIECE:
            yield start, held
            start, size, held = number + 1, 0, []
    if held:
        yield start, held


def _block_hashes(
    data: bytes, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int
) -> np.ndarray:
    """Hashes of the blocks' bytes and of where the anchor stands in them."""
    digest = xxhash.xxh3_64_intdigest
    found = (
        digest(data[a : z + length], p - a) >> 1
        for a, z, p in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True)
    )
    return np.fromiter(found, np.int64, len(first))


def _count_groups(texts: DataFrame, length: int) -> DataFrame:
    """Groups of more than one block, with the number of their blocks and of different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, piece in _pieces(batch.column(0).to_pylist()):
                _, first, last, anchor, group = blocks(piece, length)
                if not len(first):
                    continue
                block = _block_hashes(b"".join(piece), first, last, anchor, length)
                (group, block), counts = np.unique(
                    np.stack([group, block]), axis=1, return_counts=True
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group), pa.array(block), pa.array(counts)], names=["g", "block", "n"]
                )

    return (
        texts.mapInArrow(run, "g bigint, block bigint, n bigint")
        .groupBy("g", "block")
        .agg(F.sum("n").alias("n"))
        .groupBy("g")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different"))
        .where("n > 1")
    )


def _parts_of(folder: str, bits: int, groups: np.ndarray) -> np.ndarray:
    """0 for groups of one block, -1 for equal blocks, else the number of the group's parts."""
    distinct, back = np.unique(groups, return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    for at, low, high, arrays in find_sorted(folder, bits, "groups", ["g", "parts"], distinct):
        hit = low < high
        out[at[hit]] = arrays[1][low[hit]]
    return out[back]


def _contested(texts: DataFrame, folder: str, bits: int, length: int) -> DataFrame:
    """The different blocks of groups that have several: once per run of texts, with their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, piece in _pieces(batch.column(0).to_pylist()):
                _, first, last, anchor, group = blocks(piece, length)
                parts = _parts_of(folder, bits, group)
                mine = np.flatnonzero(parts > 0)
                if not len(mine):
                    continue
                data = b"".join(piece)
                first, last, group = first[mine], last[mine], group[mine]
                block = _block_hashes(data, first, last, anchor[mine], length)
                _, one, counts = np.unique(
                    np.stack([group, block]), axis=1, return_index=True, return_counts=True
                )
                first, last, group, block = first[one], last[one], group[one], block[one]
                parts = parts[mine][one]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(group),
                        pa.array(np.where(parts > 1, block % parts, 0)),
                        pa.array(block),
                        pa.array(parts),
                        pa.array(counts),
                        pa.array(last - first + 1),
                        pa.array(
                            [
                                data[a : z + length]
                                for a, z in zip(first.tolist(), last.tolist(), strict=True)
                            ],
                            pa.binary(),
                        ),
                    ],
                    names=["g", "part", "block", "parts", "n", "run", "data"],
                )

    return texts.mapInArrow(
        run,
        "g bigint, part bigint, block bigint, parts bigint, n bigint, run bigint, data binary",
    )


_FOUND = "block bigint, g bigint, low bigint, high bigint, w1 bigint, w2 bigint"


def _ranges(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of runs of neighbouring numbers."""
    cut = np.flatnonzero(np.diff(places) != 1)
    return places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)]


def _sort_chunk(rows: list[tuple], length: int) -> Iterator[tuple]:
    """Rows of _FOUND for different blocks (group, block, parts, count, run, bytes): ranges of
    window starts that repeat, and for groups in parts a window of each class."""
    data = b"".join(r[5] for r in rows)
    ends = np.cumsum([len(r[5]) for r in rows])
    begins = ends - [len(r[5]) for r in rows]
    runs = np.array([r[4] for r in rows])
    order = np.array(sorted_starts(data, begins, runs, ends, length), np.int64)
    of = classes(data, order, length)
    sizes = np.bincount(of)
    repeated = np.zeros(len(data), bool)
    repeated[order[sizes[of] > 1]] = True
    for row, begin, run in zip(rows, begins.tolist(), runs.tolist(), strict=True):
        flags = np.ones(run, bool) if row[3] > 1 else repeated[begin : begin + run]
        places = np.flatnonzero(flags)
        if len(places):
            for low, high in zip(*map(np.ndarray.tolist, _ranges(places)), strict=True):
                yield row[1], row[0], low, high, None, None
    if any(r[2] > 1 for r in rows):
        owner = np.searchsorted(ends, order, side="right")
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        for i in first.tolist():
            row, p = rows[owner[i]], int(order[i])
            if row[2] > 1:
                w = xxhash.xxh3_128_intdigest(data[p : p + length])
                place = p - int(begins[owner[i]])
                yield row[1], row[0], place, place, w >> 65, (w & ((1 << 63) - 1))


def _sort_groups(contested: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        at: tuple | None = None

        def found() -> Iterator[pa.RecordBatch]:
            out = list(_sort_chunk([tuple(r) for r in rows], length))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["block", "g", "low", "high", "w1", "w2"],
            )

        for batch in batches:
            for g, part, block, parts, n, count, data in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                if (g, part) != at:
                    if len(rows) >= CHUNK:
                        yield from found()
                        rows = []
                    at = (g, part)
                elif rows[-1][1] == block:
                    rows[-1][3] += n
                    continue
                rows.append([g, block, parts, n, count, data])
        if rows:
            yield from found()

    return (
        contested.repartition("g", "part")
        .sortWithinPartitions("g", "part", "block")
        .mapInArrow(run, _FOUND)
    )


def _cut(data: bytes, low: np.ndarray, high: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the ranges [low, high), and the ranges joined to maximal spans."""
    spans: list[list[int]] = []
    for a, z in sorted(zip(low.tolist(), high.tolist(), strict=True)):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], z)
        else:
            spans.append([a, z])
    kept, at = [], 0
    for a, z in spans:
        kept.append(data[at:a])
        at = z
    kept.append(data[at:])
    return b"".join(kept), [(a, z) for a, z in spans]


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, text_col: str = "text", group: int = GROUP
) -> DataFrame:
    """Adds ``kept`` (the remaining bytes), n_bytes, n_removed and ``spans`` (begin, end of the
    removed runs); the text column goes."""
    if length < 128:
        raise ValueError("length must be 128 at least")
    spark = docs.sparkSession
    texts = docs.select(text_of(text_col))
    folder = scratch_folder(spark, "repeats")
    system, path = place_of(folder)
    system.create_dir(path)
    bits = max(0, int(np.ceil(np.log2(max(1, docs.count() / SHARD_DOCS)))))

    parts = F.when(F.col("different") == 1, F.lit(-1)).otherwise(
        F.ceil(F.col("different") / F.lit(group))
    )
    write_sorted(
        _count_groups(texts, length).select("g", parts.cast("long").alias("parts")),
        folder,
        bits,
        "groups",
    )
    found = stored(_sort_groups(_contested(texts, folder, bits, length), length), "found")
    # windows of groups in parts that stand in several parts
    met = (
        found.where("w1 IS NOT NULL")
        .groupBy("w1", "w2")
        .agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("block", "g", "low", "high")).alias("all"))
        .where("n > 1")
        .select(F.explode("all").alias("x"))
        .select("x.*")
    )
    ranges = found.where("w1 IS NULL").select("block", "g", "low", "high").unionByName(met)
    write_sorted(ranges.distinct(), folder, bits, "ranges")

    source = with_columns(docs, _text=text_of(text_col))
    added = [
        T.StructField("kept", T.BinaryType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]
                )
            ),
        ),
    ]
    gone = {text_col.lower(), "_text", *[f.name for f in added]}
    rest = [f for f in source.schema.fields if f.name.lower() not in gone]
    out = T.StructType([*rest, *added])
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def covered(piece: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the text, begin and end of covered bytes."""
        text, first, last, anchor, groups = blocks(piece, length)
        parts = _parts_of(folder, bits, groups)
        same = np.flatnonzero(parts < 0)
        texts, lows, highs = [text[same]], [first[same]], [last[same]]
        mine = np.flatnonzero(parts > 0)
        if len(mine):
            text, first, group = text[mine], first[mine], groups[mine]
            block = _block_hashes(b"".join(piece), first, last[mine], anchor[mine], length)
            columns = ["block", "g", "low", "high"]
            for at, low, high, arrays in find_sorted(folder, bits, "ranges", columns, block):
                n = high - low
                who = np.repeat(at, n)
                rows = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                fits = arrays[1][rows] == group[who]
                who, rows = who[fits], rows[fits]
                texts.append(text[who])
                lows.append(first[who] + arrays[2][rows])
                highs.append(first[who] + arrays[3][rows])
        return np.concatenate(texts), np.concatenate(lows), np.concatenate(highs) + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, piece in _pieces(batch.column("_text").to_pylist()):
                text, low, high = covered(piece)
                order = np.argsort(text, kind="stable")
                text, low, high = text[order], low[order], high[order]
                edges = np.searchsorted(text, np.arange(len(piece) + 1))
                kept, spans, base = [], [], 0
                for i, data in enumerate(piece):
                    a, z = edges[i], edges[i + 1]
                    left, gone = _cut(data, low[a:z] - base, high[a:z] - base)
                    kept.append(left)
                    spans.append([{"begin": x, "end": y} for x, y in gone])
                    base += len(data)
                rows = batch.slice(start, len(piece))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[rows.column(f.name) for f in rest],
                        pa.array(kept, pa.binary()),
                        pa.array([len(d) for d in piece], pa.int64()),
                        pa.array(
                            [len(d) - len(k) for d, k in zip(piece, kept, strict=True)], pa.int64()
                        ),
                        pa.array(spans, span_type),
                    ],
                    names=[f.name for f in out.fields],
                )

    return source.select(*[f"`{f.name}`" for f in rest], "_text").mapInArrow(run, out)
