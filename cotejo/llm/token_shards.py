"""Training-order materialisation: every sequence gets a slot, shards hold slots in order.

Sequences of ``length`` tokens are cut from each document by itself, or with ``separator`` from the
documents of an input partition one after the other, which wastes no place. They are numbered through the input, and a keyed Feistel network with
cycle-walking maps the numbers onto the slots 0 .. n - 1, so any slot can be computed from its
number and back without a table. Each shard is a range of ``rows`` slots; one task puts its
sequences into their places of a fixed stride and writes it under a temporary name that is moved
into place when complete, so a task that runs again replaces its shard by the same bytes. A reader
seeks to any slot. Sequences travel to their shard in compressed blocks.

Numbers are the sequences counted per input partition, added up, plus the place inside the
partition. That needs an input whose partitions read alike each time: a scan of files, filtered
or projected at most. Any other input is stored first. A partition whose count differs from the
first pass raises an error.

Defined results: a document without tokens has no sequence; the last sequence of a document,
or of a partition with ``separator``, is filled with ``pad``; NULL tokens count as none; repeated rows are written as often as they occur;
an empty table gives no shards; a long text is as many sequences as it takes; only the id and the
tokens are read, whatever other columns are called.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cotejo.llm.common import stored, text_of, with_columns

_U = np.uint64
ROUNDS = 6
#: Bytes of sequences that a task gathers before it deals them to their shards.
PACKED = 1 << 25


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mix of a half and the key of a round."""
    x = x ^ _U(key & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _keys(key: int) -> list[int]:
    seeds = np.arange(1, ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    return [int(k) for k in _mixed(seeds, key)]


def _once(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    low = _U((1 << half) - 1)
    left, right = x >> _U(half), x & low
    for key in keys:
        left, right = right, left ^ (_mixed(right, key) & low)
    return (left << _U(half)) | right


def _once_back(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    low = _U((1 << half) - 1)
    left, right = x >> _U(half), x & low
    for key in reversed(keys):
        left, right = right ^ (_mixed(left, key) & low), left
    return (left << _U(half)) | right


def permute(numbers: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Slots of the numbers below n, or with ``back`` the numbers of slots."""
    out = np.asarray(numbers).astype(_U)
    if n <= 1:
        return out.astype(np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    step, keys = (_once_back if back else _once), _keys(key)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = step(out[todo], half, keys)
        todo = todo[out[todo] >= _U(n)]  # walk on along the cycle until inside
    return out.astype(np.int64)


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """File splits must not change with the number of executors between the two passes."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def _narrow(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Exchange" not in plan and "Scan parquet" in plan


@lru_cache(maxsize=2)
def _library(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {
        base64.b64decode(token): int(rank)
        for token, rank in (line.split() for line in ranks.splitlines() if line.strip())
    }
    return tiktoken.Encoding(
        "ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}
    )


def token_bytes(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    dtype: str = "uint16",
    text_col: str = "text",
    ids_col: str = "token_ids",
) -> DataFrame:
    """Adds the token ids of the text, by the library of the rank file, as binary ``dtype``. An id
    that does not fit is an error; a NULL text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a rank file: about a MB

    @F.arrow_udf("binary")
    def ids_of(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _library(shared.value, pattern).encode_ordinary
        for array in arrays:
            texts = (encode(text) for text in array.to_pylist())
            yield pa.array([np.array(ids, dtype).tobytes() for ids in texts], pa.binary())

    return with_columns(docs, **{ids_col: ids_of(text_of(text_col))})


def write_shards(
    docs: DataFrame,
    folder: str,
    key: int,
    length: int = 512,
    rows: int = 65_536,
    id_col: str = "doc_id",
    tokens_col: str = "token_ids",
    dtype: str = "uint16",
    pad: int = 0,
    separator: int | None = None,
) -> DataFrame:
    """Writes the shards and gives one row per sequence: id, seq_no, slot, shard, offset, n_tokens.

    With ``separator``, a token put behind each document that has tokens, sequences hold parts of
    several documents: the id is a list of theirs in order, seq_no the place in the partition.

    ``tokens_col`` is an array of token ids, or binary with the ids in the form of ``dtype``.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens"))
    if not _narrow(ids):
        ids = stored(ids, "tokens")
    binary = isinstance(ids.schema["tokens"].dataType, T.BinaryType)
    width = np.dtype(dtype).itemsize
    n_tokens = F.ceil(F.octet_length("tokens") / width) if binary else F.size("tokens")
    n_tokens = F.coalesce(F.greatest(n_tokens, F.lit(0)), F.lit(0))
    if separator is None:
        n_seq = F.sum(F.ceil(n_tokens / length))
    else:
        n_seq = F.ceil(F.sum(F.when(n_tokens > 0, n_tokens + 1).otherwise(0)) / length)
    with _same_splits(spark):
        # one row per partition of the input
        counts = dict(
            ids.select(F.spark_partition_id().alias("p"), "tokens")
            .groupBy("p")
            .agg(n_seq.cast("long"))
            .collect()
        )
        starts, n = {}, 0
        for part in sorted(counts):
            starts[part] = n
            n += counts[part]

        id_arrow = to_arrow_type(ids.schema["id"].dataType)
        if separator is not None:
            id_arrow = pa.list_(id_arrow)
        between = b"" if separator is None else np.array([separator], dtype).tobytes()
        step = length * width

        def packed(shards: np.ndarray, slots: np.ndarray, rows_of: list[list]) -> pa.RecordBatch:
            """One row per shard, its sequences' bytes put together and compressed."""
            order = np.argsort(shards, kind="stable")
            edges = np.flatnonzero(np.diff(shards[order], prepend=-1))
            groups = [at.tolist() for at in np.split(order, edges[1:])] if len(order) else []
            names, seq_nos, sizes, data = rows_of
            squeeze = zstandard.ZstdCompressor(level=3).compress
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(shards[g[0]]) for g in groups], pa.int64()),
                    pa.array([[names[i] for i in g] for g in groups], pa.list_(id_arrow)),
                    pa.array([[seq_nos[i] for i in g] for g in groups], pa.list_(pa.int32())),
                    pa.array([[sizes[i] for i in g] for g in groups], pa.list_(pa.int32())),
                    pa.array([slots[g] for g in groups], pa.list_(pa.int64())),
                    pa.array([squeeze(b"".join(data[i] for i in g)) for g in groups], pa.binary()),
                ],
                names=["shard", "ids", "seq_nos", "sizes", "slots", "data"],
            )

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            at, end = starts.get(part, 0), starts.get(part, 0) + counts.get(part, 0)
            held: list[list] = [[], [], [], []]
            size = 0
            rest, names, cuts = bytearray(), [], 0  # of documents that follow one another

            def keep(name: object, seq_no: int, piece: bytes) -> None:
                nonlocal size
                row = (name, seq_no, len(piece) // width, piece)
                for values, value in zip(held, row, strict=True):
                    values.append(value)
                size += len(piece)

            def flush() -> pa.RecordBatch:
                nonlocal at, held, size
                slots = permute(np.arange(at, at + len(held[0])), n, key)
                at += len(held[0])
                if at > end:
                    raise RuntimeError("the input does not read alike twice; store it first")
                block = packed(slots // rows, slots, held)
                held, size = [[], [], [], []], 0
                return block

            for batch in batches:
                for name, tokens in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
                ):
                    if not tokens:
                        continue
                    data = tokens if binary else np.array(tokens, dtype).tobytes()
                    if separator is None:
                        for seq_no, place in enumerate(range(0, len(data), step)):
                            keep(name, seq_no, data[place : place + step])
                    else:
                        rest += data + between
                        names.append(name)
                        whole = len(rest) // step
                        for place in range(0, whole * step, step):
                            keep(names, cuts, bytes(rest[place : place + step]))
                            names, cuts = [name], cuts + 1
                        del rest[: whole * step]
                        if not rest:
                            names = []
                    if size >= PACKED:
                        yield flush()
            if rest:
                keep(names, cuts, bytes(rest))
            yield flush()
            if at != end:
                raise RuntimeError("the input does not read alike twice; store it first")

        id_type = ids.schema["id"].dataType.simpleString()
        if separator is not None:
            id_type = f"array<{id_type}>"
        placed = f"id {id_type}, seq_no int, n_tokens int, slot bigint, shard bigint, offset bigint"
        filler = np.full(length, pad, dtype).tobytes()
        stride = length * width

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
            attempt = TaskContext.get().taskAttemptId()
            expand = zstandard.ZstdDecompressor().decompress
            shard, whole, filled = -1, bytearray(), np.zeros(0, np.int64)

            def done() -> None:
                if shard < 0:
                    return
                if not (filled == 1).all():
                    raise RuntimeError(f"shard {shard} lacks or repeats slots")
                with system.open_output_stream(f"{root}/tmp-{shard}-{attempt}") as stream:
                    stream.write(bytes(whole))
                system.move(f"{root}/tmp-{shard}-{attempt}", f"{root}/{shard_name(shard)}")

            for batch in batches:
                for row in range(batch.num_rows):
                    here = batch.column(0)[row].as_py()
                    if here != shard:
                        done()
                        shard = here
                        filled = np.zeros(min(rows, n - shard * rows), np.int64)
                        whole = bytearray(filler * len(filled))
                    names, seq_nos, sizes, slots = (batch.column(c)[row].values for c in range(1, 5))
                    data, at = expand(batch.column(5)[row].as_py()), 0
                    places = slots.to_numpy() - shard * rows
                    np.add.at(filled, places, 1)
                    for place, size in zip(places.tolist(), sizes.to_pylist(), strict=True):
                        size *= width
                        whole[place * stride : place * stride + size] = data[at : at + size]
                        at += size
                    shards = np.full(len(places), shard, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [names, seq_nos, sizes, slots, pa.array(shards), pa.array(places * stride)],
                        names=["id", "seq_no", "n_tokens", "slot", "shard", "offset"],
                    )
            done()

        meta = {"n": n, "length": length, "rows": rows, "dtype": dtype, "pad": pad, "key": key}
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(root)
        (
            ids.mapInArrow(
                cut,
                f"shard bigint, ids array<{id_type}>, seq_nos array<int>, sizes array<int>, "
                "slots array<bigint>, data binary",
            )
            .repartition("shard")
            .sortWithinPartitions("shard")
            .mapInArrow(write, placed)
            .write.parquet(f"{folder}/manifest")
        )
        with system.open_output_stream(f"{root}/meta.json") as out:
            out.write(json.dumps(meta).encode())
    return spark.read.parquet(f"{folder}/manifest").withColumnRenamed("id", id_col)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def read_slots(folder: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The sequences from a slot on, in order; a reader resumes at the slot it stopped at."""
    system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    with system.open_input_file(f"{root}/meta.json") as file:
        meta = json.loads(file.read())
    stride = meta["length"] * np.dtype(meta["dtype"]).itemsize
    stop = meta["n"] if stop is None else min(stop, meta["n"])
    at = start
    while at < stop:
        shard, end = at // meta["rows"], min(stop, (at // meta["rows"] + 1) * meta["rows"])
        with system.open_input_file(f"{root}/{shard_name(shard)}") as file:
            file.seek((at - shard * meta["rows"]) * stride)
            for _ in range(at, end):
                yield np.frombuffer(file.read(stride), meta["dtype"])
        at = end
