"""Damaged conversations: what is wrong with their structure, and the cheapest repair.

A conversation is right if it is empty or an optional system turn followed by pairs of a user and an
assistant turn. Faults are found and the repair is parsed over intervals (``interval_parse``) by the
tasks that conversations are dealt to. Only conversations of at most ``long_rows`` turns are read by
one task; the turns of longer ones are put in order by range, parsed in blocks that any task may
take, put together by neighbours, and repaired block by block. What alone stays in one task for them
is the SHA-256 of the repaired conversation, a stream that is never held.

Results in the odd cases: NULL in any column counts as one blank, but a NULL turn is no number for
``gaps`` and sorts first; NULL conv_id is a conversation of its own; turns with the same number are
taken by role, then text; equal rows are duplicates of the first; a role that does not begin with s,
u or a, the empty one included, is illegal beside any other and cannot be kept; a conversation
without rows (all dropped) has zeros, an empty audit and the hash of the empty text; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm import interval_parse as parse
from cotejo.llm.common import SPACE, stored

#: Turns of a conversation that one task reads, at most.
LONG_ROWS = 4096
#: Turns of a block of a longer one; blocks put together at once.
BLOCK_ROWS = 100 * parse.SPAN
FAN_IN = 32

COUNTS = ("blank", "duplicate", "truncated", "illegal")
RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy as they stand; copy tells rows made from one apart, and is -1
    for a row that only says that there is such a conversation."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _text("role").alias("role"),
        _text("text").alias("text"),
        F.lit(0).alias("copy"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Planted faults, chosen by the CRC-32 of ``conv_id:turn``: of twenty rows one is dropped, one
    loses its text, one its sentence ends, one is there twice, one becomes a user's."""
    turns = turns_of(conversations)
    code = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    empty = F.lit("")
    text = (
        F.when(F.col("_code") <= 1, empty)
        .when(F.col("_code") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    copies = (
        F.when(F.col("_code") == 0, F.array(F.lit(-1)))
        .when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1)))
        .otherwise(F.array(F.lit(0)))
    )
    role = F.when(F.col("_code") == 4, F.lit("user")).otherwise(F.col("role"))
    return turns.withColumn("_code", code).select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    )


def _kinds() -> tuple[Column, Column]:
    """Kind of the role's initial, and the fault that a row has by itself: 0, 1 truncated, 2 blank."""
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2)
    inner = F.btrim("text", F.lit(SPACE))
    ended = F.right(inner, F.lit(1)).isin(".", "!", "?")
    fault = F.when(inner == "", 2).when(ended, 0).otherwise(1)
    return initial.otherwise(parse.OTHER).alias("initial"), fault.alias("fault")


ORDER = ["conv_id", "turn", "role", "text", "copy"]


def illegal_pairs(initials: np.ndarray) -> int:
    a, b = initials[:-1], initials[1:]
    legal = ((b == 1) & ((a == 0) | (a == 2))) | ((a == 1) & (b == 2))
    return int((~legal).sum())


def _whole(rows: pd.DataFrame) -> pd.DataFrame:
    """Results of conversations whose ordered rows are all here."""
    out, sequences, turns = [], [], []
    for conv, own in rows.groupby("conv_id", sort=False, dropna=False):
        own = own[own["copy"] >= 0]
        pairs = list(zip(own["role"], own["text"], strict=True))
        seen: set[tuple[str, str]] = set()
        again = np.zeros(len(pairs), bool)
        for i, pair in enumerate(pairs):
            again[i] = pair in seen
            seen.add(pair)
        initials, faults = own["initial"].to_numpy(), own["fault"].to_numpy()
        blank = faults == 2
        again &= ~blank
        short = (faults == 1) & ~again
        numbers = [int(t) for t in own["turn"] if not pd.isna(t)]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        counts = [gaps, blank.sum(), again.sum(), short.sum(), illegal_pairs(initials)]
        out.append([conv, *map(int, counts), 0, "", ""])
        turns.append(pairs)
        doomed = blank | again
        sequences.append(initials * 3 + np.where(doomed, parse.DOOMED, short))
    full = [i for i, kinds in enumerate(sequences) if len(kinds)]
    for i, cells in zip(full, parse.span_cells([sequences[i] for i in full]), strict=True):
        out[i][6], out[i][7] = parse.conclusion(cells)
    for row, pairs in zip(out, turns, strict=True):
        repaired = "\n".join(parse.Repair().lines(row[7], pairs))
        row[8] = hashlib.sha256(repaired.encode("utf-8", "surrogatepass")).hexdigest()
    return pd.DataFrame(out, columns=["conv_id", *_names()])


def _names() -> list[str]:
    return [part.split()[0] for part in RESULT.split(", ")]


def _schema() -> pa.Schema:
    types = {"long": pa.int64(), "string": pa.string()}
    fields = [part.split() for part in f"conv_id long, {RESULT}".split(", ")]
    return pa.schema([(name, types[kind]) for name, kind in fields])


def _batch(rows: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(rows, schema=schema, preserve_index=False)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Sorted rows in runs that end with a conversation."""
    held = []
    for batch in batches:
        rows = batch.to_pandas(integer_object_nulls=True)
        if not len(rows):
            continue
        last = rows["conv_id"].iloc[-1]
        open_rows = rows["conv_id"].isna() if pd.isna(last) else rows["conv_id"].eq(last)
        # the last conversation of the batch may go on in the next one
        start = len(rows) - int(open_rows.to_numpy()[::-1].cumprod().sum())
        if start:
            yield pd.concat([*held, rows.iloc[:start]], ignore_index=True)
            held = []
        held.append(rows.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _repair_short(turns: DataFrame) -> DataFrame:
    schema = _schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            yield _batch(_whole(rows), schema)

    dealt = turns.select(*ORDER, *_kinds()).repartition("conv_id").sortWithinPartitions(*ORDER)
    return dealt.mapInArrow(run, f"conv_id long, {RESULT}")


def _numbered(turns: DataFrame) -> DataFrame:
    """Rows of long conversations in order: ``part`` and ``seq``, with the block they belong to."""
    names = ["conv_id", "turn", "role", "text", "initial", "fault", "pos", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            pos = first + np.arange(batch.num_rows, dtype=np.int64)
            first += batch.num_rows
            columns = [batch.column(n) for n in names[:-2]]
            blocks = (pos >> 40 << 40) | ((pos & ((1 << 40) - 1)) // BLOCK_ROWS)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pos), pa.array(blocks)], names=names)

    keys = ["conv_id", "turn", "role", F.substring("text", 1, 32)]  # agrees with the order of texts
    ordered = turns.where("copy >= 0").select(*ORDER, *_kinds()).repartitionByRange(*keys)
    return ordered.sortWithinPartitions(*ORDER).mapInArrow(
        run,
        "conv_id long, turn long, role string, text string, initial int, fault int, "
        "pos long, block long",
    )


SUMMARY = (
    "conv_id long, block long, sizes array<long>, blocks array<long>, blank long, duplicate long, "
    "truncated long, illegal long, first int, last int, low long, high long, turns long, "
    "costs array<long>, audits array<string>"
)


def _flat(cells: parse.Cells) -> tuple[list, list]:
    flat = [c for row in cells for c in row]
    return [c and c[0] for c in flat], [c and c[1] for c in flat]


def _square(costs: list, audits: list) -> parse.Cells:
    flat = [None if c is None else (int(c), a) for c, a in zip(costs, audits, strict=True)]
    return [flat[i : i + parse.STATES] for i in range(0, len(flat), parse.STATES)]


def _block_summary(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    fault = rows["fault"].to_numpy()
    again = rows["again"].to_numpy(zero_copy_only=False) & (fault != 2)
    initials = rows["initial"].to_numpy()
    short = (fault == 1) & ~again
    kinds = initials * 3 + np.where((fault == 2) | again, parse.DOOMED, short)
    numbers = [t for t in rows["turn"].to_pylist() if t is not None]
    costs, audits = _flat(parse.span_cells([kinds])[0])
    counts = [int((fault == 2).sum()), int(again.sum()), int(short.sum()), illegal_pairs(initials)]
    low, high = (min(numbers), max(numbers)) if numbers else (None, None)
    conv, block = (k.as_py() for k in key)
    ends = [int(initials[0]), int(initials[-1]), low, high, len(set(numbers))]
    return _table([[conv, block, [len(kinds)], [block], *counts, *ends, costs, audits]])


def _table(rows: list[list]) -> pa.Table:
    kinds = {
        "long": pa.int64(),
        "int": pa.int32(),
        "array<long>": pa.list_(pa.int64()),
        "array<string>": pa.list_(pa.string()),
    }
    fields = [part.split() for part in SUMMARY.split(", ")]
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
    columns = list(zip(*rows, strict=True))
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    """Neighbouring spans as one; their order is that of the first block."""
    found = rows.sort_by("block").to_pylist()
    out = found[0]
    for row in found[1:]:
        out["illegal"] += row["illegal"] + illegal_pairs(np.array([out["last"], row["first"]]))
        shared = out["high"] is not None and out["high"] == row["low"]
        out["turns"] += row["turns"] - int(shared)
        if out["low"] is None:
            out["low"] = row["low"]
        out["high"] = row["high"] if row["high"] is not None else out["high"]
        for name in ("sizes", "blocks", "blank", "duplicate", "truncated"):
            out[name] = out[name] + row[name]
        out["last"] = row["last"]
    cells = parse.combined([_square(r["costs"], r["audits"]) for r in found])
    out["costs"], out["audits"] = _flat(cells)
    names = [part.split()[0] for part in SUMMARY.split(", ")]
    return _table([[out[n] for n in names]])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of a conversation cut up by its blocks, with the state that each begins in."""
    for batch in batches:
        for row in batch.to_pylist():
            audit = row["audit"]
            # pairs end it, so an odd number of turns means that a system turn leads
            led = (len(audit) - audit.count("D")) % 2
            at, done, cuts, states = 0, 0, [], []
            for size in row["sizes"]:
                states.append(_state(done, led))
                start = at
                while size or (at < len(audit) and audit[at] == "I"):
                    size -= audit[at] != "I"
                    done += audit[at] != "D"
                    at += 1
                cuts.append(audit[start:at])
            ids = [pa.array([row["conv_id"]] * len(cuts), pa.int64()), pa.array(row["blocks"])]
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(cuts, pa.string()), pa.array(states, pa.int32())],
                names=["conv_id", "block", "cut", "state"],
            )


def _state(done: int, led: int) -> int:
    if done <= led:
        return parse.SYSTEM if done else parse.START
    return parse.USER if (done - led) % 2 else parse.ASSISTANT


def _repaired(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    turns = list(zip(rows["role"].to_pylist(), rows["text"].to_pylist(), strict=True))
    lines = parse.Repair(rows["state"][0].as_py()).lines(rows["cut"][0].as_py(), turns)
    out = [[key[0].as_py()], [key[1].as_py()], [len(lines)], ["\n".join(lines)]]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
    return pa.table(columns, names=["conv_id", "block", "lines", "repaired"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation, fed block by block."""
    names = ["conv_id", "repaired_sha256"]

    def done(conv: int | None, state: hashlib._Hash) -> pa.RecordBatch:
        columns = [pa.array([conv], pa.int64()), pa.array([state.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    here, state, begun = None, None, False
    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != here:
                if state is not None:
                    yield done(here, state)
                here, state, begun = row["conv_id"], hashlib.sha256(), False
            if row["lines"]:
                state.update(b"\n" * begun + row["repaired"].encode())
                begun = True
    if state is not None:
        yield done(here, state)


def _repair_long(turns: DataFrame) -> DataFrame:
    rows = stored(_numbered(turns), "turns")
    same = F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"))
    firsts = rows.groupBy("conv_id", same).agg(F.min("pos").alias("pos")).select(
        "pos", F.lit(False).alias("again")
    )
    judged = rows.drop("role", "text").join(firsts, "pos", "left")
    judged = judged.withColumn("again", F.coalesce("again", F.lit(True)))
    spans = stored(judged.groupBy("conv_id", "block").applyInArrow(_block_summary, SUMMARY), "spans")
    ahead = Window.partitionBy("conv_id").orderBy("block")
    while spans.groupBy("conv_id").count().where("count > 1").limit(1).count():
        group = F.floor((F.row_number().over(ahead) - 1) / FAN_IN).alias("_group")
        merged = spans.select("*", group).groupBy("conv_id", "_group").applyInArrow(_merge, SUMMARY)
        spans = stored(merged, "spans")
    roots = stored(spans.mapInArrow(_conclusions, ROOT), "roots")
    cuts = roots.mapInArrow(_slices, "conv_id long, block long, cut string, state int")
    cuts = cuts.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    at_home = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    blocks = (
        rows.select("conv_id", "block", "pos", "role", "text")
        .join(cuts, at_home)
        .drop("_conv", "_block")
        .groupBy("conv_id", "block")
        .applyInArrow(_repaired, "conv_id long, block long, lines long, repaired string")
    )
    hashes = (
        blocks.repartition("conv_id")
        .sortWithinPartitions("conv_id", "block")
        .mapInArrow(_hashes, "conv_id long, repaired_sha256 string")
        .withColumnRenamed("conv_id", "_conv")
    )
    found = roots.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return found.select("conv_id", *_names())


ROOT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, sizes array<long>, blocks array<long>"
)


def _conclusions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            cost, audit = parse.conclusion(_square(row["costs"], row["audits"]))
            gaps = row["high"] - row["low"] + 1 - row["turns"] if row["turns"] else 0
            values = [row["conv_id"], gaps, *(row[c] for c in COUNTS), cost, audit]
            kinds = [pa.int64()] * 7 + [pa.string()]
            columns = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
            lists = [pa.array([row[n]], pa.list_(pa.int64())) for n in ("sizes", "blocks")]
            names = ["conv_id", "gaps", *COUNTS, "cost", "audit", "sizes", "blocks"]
            yield pa.RecordBatch.from_arrays([*columns, *lists], names=names)


def repair(turns: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """Per conversation: gaps in its numbering, rows by their first fault, illegal neighbours, cost
    and audit of the cheapest repair, and the hash of the repaired conversation.

    ``turns``: from ``turns_of`` or ``damaged``. A row that is kept costs nothing, one given another
    role 2, one deleted 3, an inserted one without text 2; blank and duplicate rows must go, a row
    without a sentence end costs 1 more where it stays.
    """
    count = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long_rows)
    long = stored(count.select(F.col("conv_id").alias("_long")), "long")
    if long.isEmpty():
        return _repair_short(turns)
    listed = F.col("conv_id").eqNullSafe(F.col("_long"))
    short = _repair_short(turns.join(long, listed, "left_anti"))
    found = _repair_long(turns.join(long, listed, "left_semi"))
    # one whose rows were all dropped has none to put in order
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    filled = [F.coalesce(n, F.lit(none.get(n, 0))).alias(n) for n in _names()]
    return short.union(long.join(found, listed, "left").select("_long", *filled))
