"""Arrays in files of the shared folder: written by tasks, memory-mapped by workers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def place_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ArrayWriter:
    """Appends to a file under a temporary name and moves it into place when complete."""

    def __init__(self, uri: str, attempt: int) -> None:
        self.system, self.path = place_of(uri)
        self.part = f"{self.path}.{attempt}.part"
        self.stream = self.system.open_output_stream(self.part)

    def add(self, values: np.ndarray) -> None:
        self.stream.write(np.ascontiguousarray(values).tobytes())

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.part, self.path)


@lru_cache(maxsize=4096)
def mapped(uri: str, dtype: str) -> np.ndarray:
    """The array of a file, memory-mapped; a missing file is an error. One in a store that cannot be
    mapped is read into memory, where the table of this function keeps it as long as it is used."""
    system, path = place_of(uri)
    info = system.get_file_info(path)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(f"{uri} was written and is gone")
    if not info.size:
        return np.zeros(0, dtype)
    if not isinstance(system, fs.LocalFileSystem):
        with system.open_input_file(path) as file:
            return np.frombuffer(file.read(), dtype)
    return np.memmap(path, dtype, "r")


def write_manifest(uri: str, name: str, shards: dict[int, int]) -> None:
    """The shards that there are, with their number of values: what is not listed is empty."""
    system, path = place_of(f"{uri}/{name}-shards.json")
    with system.open_output_stream(path) as out:
        out.write(json.dumps({str(k): n for k, n in sorted(shards.items())}).encode())


@lru_cache(maxsize=256)
def manifest(uri: str, name: str) -> dict[int, int]:
    system, path = place_of(f"{uri}/{name}-shards.json")
    with system.open_input_file(path) as file:
        return {int(k): n for k, n in json.loads(file.read()).items()}


def shard_array(uri: str, name: str, column: str, shard: int, dtype: str) -> np.ndarray:
    """A column of a shard: empty if none was written, an error if it is not as it was written."""
    size = manifest(uri, name).get(int(shard), 0)
    if not size:
        return np.zeros(0, dtype)
    values = mapped(f"{uri}/{column}-{shard}", dtype)
    if len(values) != size:
        raise OSError(f"{uri}/{column}-{shard} has {len(values)} values of {size}")
    return values


def write_sorted(rows: DataFrame, uri: str, bits: int, name: str) -> None:
    """Columns of longs as arrays sorted by the first one, a hash of 63 bits; one file per column
    and shard, the shard being the hash's first bits. A manifest lists the shards."""
    columns = rows.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, shard, out, size = TaskContext.get().taskAttemptId(), -1, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            for writer in out:
                writer.close()
            if out:
                arrays = [pa.array([v], pa.int64()) for v in (shard, size)]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "size"])

        for batch in batches:
            shards = batch.column(0).to_numpy()
            for here in np.unique(shards):
                if here != shard:
                    yield from close()
                    shard, size = int(here), 0
                    out = [ArrayWriter(f"{uri}/{name}-{c}-{here}", attempt) for c in columns]
                mine = shards == here
                size += int(mine.sum())
                for writer, column in zip(out, batch.columns[1:], strict=True):
                    writer.add(column.to_numpy()[mine])
        yield from close()

    written = (
        rows.select(F.shiftright(columns[0], 63 - bits).alias("_shard"), "*")
        .repartition("_shard")
        .sortWithinPartitions("_shard", *columns)
        .mapInArrow(write, "shard bigint, size bigint")
        .collect()  # a row per shard
    )
    write_manifest(uri, name, {row["shard"]: row["size"] for row in written})


def find_sorted(
    uri: str, bits: int, name: str, columns: list[str], wanted: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """By shard: places in ``wanted``, from and to of the rows with that hash, and the arrays."""
    shards = wanted >> (63 - bits)
    for shard in np.unique(shards):
        at = np.flatnonzero(shards == shard)
        arrays = [shard_array(uri, name, f"{name}-{c}", shard, "<i8") for c in columns]
        yield (
            at,
            np.searchsorted(arrays[0], wanted[at], side="left"),
            np.searchsorted(arrays[0], wanted[at], side="right"),
            arrays,
        )
