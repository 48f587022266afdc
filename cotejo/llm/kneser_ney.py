"""An interpolated, modified Kneser-Ney bigram model, counted in Spark.

Words are numbered by the order of their hashes. A pair of words is one 64-bit code, the number of
the first word above that of the second. Tasks count words and pairs of their documents, Spark
shuffles and sorts the counts, and tasks write sorted arrays of hashes and codes with their counts
into the shared folder. Workers memory-map the arrays and look up whole batches in sorted order.

Words are dealt into shards by their hash and pairs by their first word; first words with many
pairs are dealt by both words. Sums per word or context are only ever added up. The number of
shards follows the number of documents; nothing is pruned or sampled.

Defined results: NULL counts as empty, which is one token, the end; words that training has not
seen share one part of the uniform remainder; repeated rows count as often as they occur; without
training rows every token has the probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.llm.arrays import ArrayWriter, mapped, place_of
from cotejo.llm.common import scratch_folder, stored, text_of, with_columns

#: Bytes of text per shard; bytes of a word, about; bits of the numbers in a dense array's file.
SHARD_BYTES = 1 << 25
WORD_BYTES = 6
BLOCK_BITS = 18
#: Characters handled at once, which bounds what a worker holds; partitions of a shuffle, at most.
PIECE = 4_000_000
MOST_PARTS = 1 << 15
#: A first word with this many times the mean of a shard is dealt by both words.
HOT_SHARE = 0.125
HOT_PARTS = 64
BUFFER = 1 << 20
END = b"\n"


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42) >> 1


def _hashes(words: pa.Array) -> np.ndarray:
    found = map(_hash, words.cast(pa.binary()).to_pylist())
    return np.fromiter(found, np.int64, len(words))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of some texts, A-Z in lower case; the place among them of every word in
    order; and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, of = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(full).dictionary_encode()
    counts = np.bincount(of.filter(full).to_numpy(), minlength=len(texts))
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), counts


@dataclass(frozen=True)
class Words:
    """Where the sorted hashes are, and the number of the first word of each shard."""

    folder: str
    bits: int
    first: np.ndarray
    n_tokens: int

    @property
    def size(self) -> int:
        return int(self.first[-1])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes; the size for unknown ones."""
        out = np.full(len(hashes), self.size, np.int64)
        shards = hashes >> (63 - self.bits)
        for shard in np.unique(shards):
            if self.first[shard] == self.first[shard + 1]:
                continue
            at = np.flatnonzero(shards == shard)
            keys = mapped(f"{self.folder}/words-{shard}", "<i8")
            place = np.searchsorted(keys, hashes[at])
            hit = place < len(keys)
            hit[hit] = keys[place[hit]] == hashes[at][hit]
            out[at[hit]] = self.first[shard] + place[hit]
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        shards = np.searchsorted(self.first, numbers, side="right") - 1
        for shard in np.unique(shards):
            if shard < len(self.first) - 1:
                at = np.flatnonzero(shards == shard)
                counts = mapped(f"{self.folder}/counts-{shard}", "<i8")
                out[at] = counts[numbers[at] - self.first[shard]]
        return out


def _groups(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in runs of about PIECE characters."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PIECE, side="right")))
        yield texts[start:stop]
        start = stop


@dataclass(frozen=True)
class Tokens:
    """Tokens of some texts as places in ``numbers``: those of the different words, then the end's
    and the start's. ``before`` holds the places of the tokens before them."""

    numbers: np.ndarray
    at: np.ndarray
    before: np.ndarray
    lengths: np.ndarray

    @property
    def codes(self) -> np.ndarray:
        return self.numbers[self.before] << 32 | self.numbers[self.at]


def tokens_of(texts: pa.Array, words: Words) -> Tokens:
    found, at, counts = split_words(texts)
    hashes = np.append(_hashes(found), _hash(END))
    order = np.argsort(hashes)
    numbers = np.empty(len(hashes) + 1, np.int64)
    numbers[order] = words.numbers(hashes[order])
    numbers[-1] = words.size + 1
    lengths = counts + 1
    ends = np.cumsum(lengths) - 1
    inside = np.ones(int(lengths.sum()), bool)
    inside[ends] = False
    places = np.full(len(inside), len(found), np.int64)
    places[inside] = at
    before = np.empty_like(places)
    before[1:] = places[:-1]
    before[ends - counts] = len(found) + 1
    return Tokens(numbers, places, before, lengths)


def count_words(
    docs: DataFrame, folder: str, bits: int, text_col: str, limit: int
) -> tuple[Words, np.ndarray]:
    """The words, and the numbers of those found more than ``limit`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _groups(batch.column(0)):
                found, at, _ = split_words(texts)
                hashes = np.append(_hashes(found), _hash(END))
                counts = np.append(np.bincount(at, minlength=len(found)), len(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes), pa.array(counts)], names=["h", "n"]
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, shard, out, totals = TaskContext.get().taskAttemptId(), -1, None, [0, 0]
        for batch in batches:
            shards = batch.column(0).to_numpy()
            hashes, counts = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for here in np.unique(shards):
                if here != shard:
                    if out:
                        [o.close() for o in out]
                        yield _totals(shard, totals, hot)
                    shard, totals, hot = here, [0, 0], []
                    names = (f"{folder}/words-{here}", f"{folder}/counts-{here}")
                    out = [ArrayWriter(name, attempt) for name in names]
                mine = shards == here
                out[0].add(hashes[mine])
                out[1].add(counts[mine])
                hot += (totals[0] + np.flatnonzero(counts[mine] > limit)).tolist()
                totals = [totals[0] + int(mine.sum()), totals[1] + int(counts[mine].sum())]
        if out:
            [o.close() for o in out]
            yield _totals(shard, totals, hot)

    def _totals(shard: int, totals: list[int], hot: list[int]) -> pa.RecordBatch:
        arrays = [pa.array([v], pa.int64()) for v in (shard, *totals)]
        arrays.append(pa.array([hot], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "size", "tokens", "hot"])

    rows = (
        docs.select(text_of(text_col))
        .mapInArrow(count, "h bigint, n bigint")
        .groupBy("h")
        .agg(F.sum("n").alias("n"))
        .select(F.shiftright("h", 63 - bits).alias("shard"), "h", "n")
        .repartitionById(*_parts(bits))
        .sortWithinPartitions("h")
        .mapInArrow(write, "shard bigint, size bigint, tokens bigint, hot array<bigint>")
        .collect()  # a row per shard
    )
    sizes = np.zeros(1 << bits, np.int64)
    for row in rows:
        sizes[row["shard"]] = row["size"]
    first = np.concatenate([[0], np.cumsum(sizes)])
    if first[-1] > (1 << 31) - 3:
        raise OverflowError("a pair of words does not fit 64 bits: too many different words")
    hot = [first[row["shard"]] + place for row in rows for place in row["hot"]]
    words = Words(folder, bits, first, sum(row["tokens"] for row in rows))
    return words, np.array(sorted(hot), np.int64)


def _parts(bits: int) -> tuple[int, Column]:
    """Number of partitions, and the partition of a shard: its own, unless there are too many."""
    n = min(1 << bits, MOST_PARTS)
    return n, F.shiftright("shard", max(0, bits - 15)).cast("int")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Dealing:
    """The shard of a pair: by its first word, or by both if the first word is a frequent one."""

    bits: int
    hot: np.ndarray  # sorted numbers

    def shard(self, codes: np.ndarray) -> np.ndarray:
        first, second = codes >> 32, codes & 0xFFFFFFFF
        salt = np.where(np.isin(first, self.hot), 1 + second % HOT_PARTS, 0)
        mixed = _mix(first * (HOT_PARTS + 1) + salt) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else first * 0


def _discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more from the numbers of counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    found = [
        (k + 1) - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.0 for k in range(3)
    ]
    return np.array([min(max(d, 0.0), k + 1.0) for k, d in enumerate(found)])


def _discount(counts: np.ndarray, by: np.ndarray) -> np.ndarray:
    return by[np.clip(counts, 1, 3) - 1]


def count_pairs(
    docs: DataFrame, words: Words, dealing: Dealing, folder: str, text_col: str
) -> DataFrame:
    """Writes the sorted codes; sums to add up: ``kind`` 0 per context, 1 per second word (as n1,
    its number of contexts), 2 numbers of counts 1 to 4 of all pairs; 3 is the size of a shard."""
    parts, own = _parts(dealing.bits)
    order = ["code"] if parts == 1 << dealing.bits else ["shard", "code"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _groups(batch.column(0)):
                codes, counts = np.unique(tokens_of(texts, words).codes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(dealing.shard(codes)), pa.array(codes), pa.array(counts)],
                    names=["shard", "code", "n"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, shard, out = TaskContext.get().taskAttemptId(), -1, None
        last: tuple[np.ndarray, np.ndarray] | None = None
        seconds: list[np.ndarray] = []
        held = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, n = np.unique(np.concatenate(seconds), return_counts=True)
            yield _sums(1, ids, n1=n)

        def take(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Codes that are complete, each once."""
            nonlocal size
            if counts.max() > 0xFFFFFFFF:
                raise OverflowError("a pair is found too often for 32 bits")
            size += len(codes)
            out[0].add(codes)
            out[1].add(counts.astype(np.uint32))
            first = codes >> 32
            starts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            sums = {f"n{k}": np.add.reduceat((counts == k).astype(np.int64), starts) for k in (1, 2)}
            sums["n3"] = np.add.reduceat((counts >= 3).astype(np.int64), starts)
            yield _sums(0, first[starts], total=np.add.reduceat(counts, starts), **sums)
            totals = {f"n{k}": np.array([np.count_nonzero(counts == k)]) for k in (1, 2, 3, 4)}
            yield _sums(2, np.zeros(1, np.int64), **totals)

        for batch in batches:
            shards = batch.column(0).to_numpy()
            codes, counts = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for here in np.unique(shards):
                mine = shards == here
                c, n = codes[mine], counts[mine]
                if here != shard:
                    if out:
                        yield from take(*last)
                        seconds.append(last[0] & 0xFFFFFFFF)
                        [o.close() for o in out]
                        yield _sums(3, np.array([shard]), total=np.array([size]))
                    shard, last, size = here, None, 0
                    names = (f"{folder}/pairs-{here}", f"{folder}/pair-counts-{here}")
                    out = [ArrayWriter(name, attempt) for name in names]
                if last is not None:
                    c, n = np.concatenate([last[0], c]), np.concatenate([last[1], n])
                starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                c, n = c[starts], np.add.reduceat(n, starts)
                last = c[-1:], n[-1:]  # may go on in the next batch
                if len(c) > 1:
                    yield from take(c[:-1], n[:-1])
                    seconds.append(c[:-1] & 0xFFFFFFFF)
                    held += len(c)
                    if held > BUFFER:
                        yield from flush()
                        seconds, held = [], 0
        if out:
            yield from take(*last)
            seconds.append(last[0] & 0xFFFFFFFF)
            [o.close() for o in out]
            yield _sums(3, np.array([shard]), total=np.array([size]))
        if seconds:
            yield from flush()

    return (
        docs.select(text_of(text_col))
        .mapInArrow(count, "shard bigint, code bigint, n bigint")
        .repartitionById(parts, own)
        .sortWithinPartitions(*order)
        .mapInArrow(write, _SUMS)
    )


_SUMS = "kind int, id bigint, total bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint"


def _sums(kind: int, ids: np.ndarray, **sums: np.ndarray) -> pa.RecordBatch:
    zero = np.zeros(len(ids), np.int64)
    names = ["total", "n1", "n2", "n3", "n4"]
    columns = [pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids.astype(np.int64))]
    columns += [pa.array(sums.get(name, zero).astype(np.int64)) for name in names]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "id", *names])


def _write_blocks(rows: DataFrame, uri: str, names: list[str]) -> frozenset[int]:
    """Columns of numbers by ``id`` as dense arrays, one file per column and block of ids. Gives the
    blocks that there are."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, block, held = TaskContext.get().taskAttemptId(), -1, []

        def save() -> None:
            ids = np.concatenate([b[0] for b in held])
            for k, name in enumerate(names):
                dense = np.zeros(1 << BLOCK_BITS, np.float64)
                dense[ids & ((1 << BLOCK_BITS) - 1)] = np.concatenate([b[1][k] for b in held])
                out = ArrayWriter(f"{uri}/{name}-{block}", attempt)
                out.add(dense.astype(np.float32))
                out.close()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64())], names=["block"])

        for batch in batches:
            blocks, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = [batch.column(2 + k).to_numpy() for k in range(len(names))]
            for here in np.unique(blocks):
                if here != block:
                    if held:
                        save()
                        yield done()
                    block, held = int(here), []
                mine = blocks == here
                held.append((ids[mine], [v[mine] for v in values]))
        if held:
            save()
            yield done()

    blocks = F.shiftright("id", BLOCK_BITS).alias("block")
    written = (
        rows.select(blocks, "id", *[F.col(n).cast("double").alias(n) for n in names])
        .repartition("block")
        .sortWithinPartitions("block", "id")
        .mapInArrow(write, "block bigint")
        .collect()  # a row per block
    )
    return frozenset(row["block"] for row in written)


def _dense(uri: str, name: str, there: frozenset[int], numbers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(numbers), np.float64)
    blocks = numbers >> BLOCK_BITS
    for block in np.unique(blocks):
        if int(block) in there:
            at = np.flatnonzero(blocks == block)
            values = mapped(f"{uri}/{name}-{block}", "<f4")
            out[at] = values[numbers[at] & ((1 << BLOCK_BITS) - 1)]
    return out


@dataclass(frozen=True)
class Model:
    folder: str
    words: Words
    dealing: Dealing
    discounts: np.ndarray
    uniform: float  # probability that every word, and the unknown one, has of the remainder
    sizes: dict[int, int]  # pairs of each shard that has some
    contexts: frozenset[int]  # blocks of the dense arrays
    seconds: frozenset[int]

    def pair_counts(self, codes: np.ndarray) -> np.ndarray:
        """Counts of sorted codes."""
        out = np.zeros(len(codes), np.int64)
        shards = self.dealing.shard(codes)
        order = np.argsort(shards, kind="stable")
        edges = np.flatnonzero(np.diff(shards[order], prepend=-1))
        for at in np.split(order, edges[1:]):
            if not len(at):
                continue
            shard, wanted = int(shards[at[0]]), codes[at]
            if shard not in self.sizes:
                continue
            keys = mapped(f"{self.folder}/pairs-{shard}", "<i8")
            if len(keys) != self.sizes[shard]:
                raise OSError(f"shard {shard} has {len(keys)} pairs of {self.sizes[shard]}")
            place = np.searchsorted(keys, wanted)
            hit = place < len(keys)
            hit[hit] = keys[place[hit]] == wanted[hit]
            counts = mapped(f"{self.folder}/pair-counts-{shard}", "<u4")
            out[at[hit]] = counts[place[hit]]
        return out

    def probability(self, tokens: Tokens) -> np.ndarray:
        """Of tokens after those before them."""
        numbers = tokens.numbers
        alone = _dense(self.folder, "alone", self.seconds, numbers)
        low = (np.where(numbers < self.words.size, alone, 0.0) + self.uniform)[tokens.at]
        total = _dense(self.folder, "total", self.contexts, numbers)[tokens.before]
        left = _dense(self.folder, "left", self.contexts, numbers)[tokens.before]
        codes, back = np.unique(tokens.codes, return_inverse=True)
        counts = self.pair_counts(codes)
        high = np.where(counts > 0, counts - _discount(counts, self.discounts), 0.0)[back]
        return np.where(total > 0, high / np.maximum(total, 1) + left * low, low)


def train(docs: DataFrame, text_col: str = "text", folder: str | None = None) -> Model:
    spark = docs.sparkSession
    folder = folder or scratch_folder(spark, "kneser-ney")
    system, path = place_of(folder)
    system.create_dir(path)
    size = F.sum(F.octet_length(text_of(text_col)).cast("long"))
    n_docs, n_bytes = docs.agg(F.count(F.lit(1)), size).first()
    bits = max(0, int(np.ceil(np.log2(max(1, (n_bytes or 0) / SHARD_BYTES)))))
    limit = max(1, int(HOT_SHARE * (n_bytes or 0) / WORD_BYTES / (1 << bits)))
    words, hot = count_words(docs, folder, bits, text_col, limit)
    if n_docs > limit:
        hot = np.append(hot, words.size + 1)  # the start
    dealing = Dealing(bits, hot)
    sums = stored(count_pairs(docs, words, dealing, folder, text_col), "pair-sums")
    names = ["n1", "n2", "n3", "n4"]
    row = sums.where("kind = 2").agg(*[F.sum(n).alias(n) for n in names]).first()
    discounts = _discounts([row[n] or 0 for n in names])
    contexts = sums.where("kind = 0").groupBy("id").agg(
        *[F.sum(n).alias(n) for n in ("total", "n1", "n2", "n3")]
    )
    left = sum(F.lit(float(d)) * F.col(n) for d, n in zip(discounts, names, strict=False))
    context_blocks = _write_blocks(
        contexts.select("id", "total", (left / F.col("total")).alias("left")),
        folder,
        ["total", "left"],
    )
    # the lower order counts the different words before a word
    after = stored(
        sums.where("kind = 1").groupBy("id").agg(F.sum("n1").alias("n")), "second-words"
    )
    of = [F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    of.append(F.sum((F.col("n") >= 3).cast("long")).alias("many"))
    row = after.agg(*of, F.sum("n").alias("all")).first()
    lower = _discounts([row[n] or 0 for n in names])
    total = row["all"] or 0
    by = F.element_at(F.array(*[F.lit(float(d)) for d in lower]), F.least("n", F.lit(3)).cast("int"))
    second_blocks = _write_blocks(
        after.select("id", ((F.col("n") - by) / F.lit(max(total, 1))).alias("alone")),
        folder,
        ["alone"],
    )
    given = sum(d * (row[n] or 0) for d, n in zip(lower, ("n1", "n2", "many"), strict=True))
    uniform = (given / total if total else 1.0) / (words.size + 1 if total else 1)
    sizes = {r["id"]: r["total"] for r in sums.where("kind = 3").collect()}  # a row per shard
    return Model(
        folder, words, dealing, discounts, uniform, sizes, context_blocks, second_blocks
    )


_SCORES = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_known", T.LongType()),
    T.StructField("base_score", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
]


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, base_score (smoothed single words) and score, the base-10 logarithm
    of the model's probability of the text; the text column goes."""
    source = with_columns(docs, _text=text_of(text_col))
    gone = {text_col.lower(), "_text", *[f.name for f in _SCORES]}
    rest = [f for f in source.schema.fields if f.name.lower() not in gone]
    out = T.StructType([*rest, *_SCORES])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # paths, and a number per shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = model.words
        for batch in batches:
            found: list[list[np.ndarray]] = [[], [], [], []]
            for texts in _groups(batch.column("_text")):
                tokens = tokens_of(texts, words)
                at, lengths = tokens.at, tokens.lengths
                starts = np.cumsum(lengths) - lengths
                counts = words.counts(tokens.numbers)
                base = np.log10((counts + 0.1) / (words.n_tokens + 0.1 * (words.size + 1)))
                own = np.log10(model.probability(tokens))
                found[0].append(lengths)
                found[1].append(np.add.reduceat((counts > 0)[at].astype(np.int64), starts))
                found[2].append(np.add.reduceat(base[at], starts))
                found[3].append(np.add.reduceat(own, starts))
            kinds = (np.int64, np.int64, np.float64, np.float64)
            arrays = [
                pa.array(np.concatenate([*f, np.zeros(0)]).astype(kind))
                for f, kind in zip(found, kinds, strict=True)
            ]
            columns = [batch.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays(
                [*columns, *arrays], names=[f.name for f in out.fields]
            )

    return source.select(*[f"`{f.name}`" for f in rest], "_text").mapInArrow(run, out)
