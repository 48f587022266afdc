"""Quality by nearest-neighbour voting on latent-semantic vectors.

A text is a vector of hashed byte trigrams, damped and weighted, and of a few terms that say how
much it repeats itself at short distances; a truncated singular value decomposition of a bounded
sample of labelled texts turns it into a short latent vector. The
sample's latent vectors and labels, a few MB at most, are broadcast; for every document the
cosines to all of them are computed block by block, and the nearest vote for their label with
their similarity as weight.

The sample holds at most ``per_class`` rows of each label, whatever the input's size; the share of
each label in the votes is corrected for that by the labels' share among all labelled rows.

Defined results: NULL counts as empty; a text without features gets the share of label 1; equal
texts score alike; without labelled rows of both kinds the score is that share (0.5 without any);
a column of the input that has the name of a result column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.llm.common import text_of, with_columns
from cotejo.llm.labelled import labelled_sample

BUCKETS = 2048
PER_CLASS = 1000
DIMENSIONS = 64
NEIGHBOURS = 7
BLOCK_ROWS = 512
#: Longest distance at which bytes are compared, the limits between the terms for the share of
#: equal bytes, and the weight of these terms beside a trigram vector of length one.
LAGS = 24
REPEAT_LIMITS = (0.15, 0.25, 0.4, 0.7)
REPEAT_WEIGHT = 0.8
TERMS = BUCKETS + len(REPEAT_LIMITS) + 1


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the trigram buckets
    projection: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # sample x dimensions, of length one
    labels: np.ndarray
    share: float  # of label 1 among all labelled rows
    neighbours: int


def counts(texts: list[str]) -> np.ndarray:
    """Damped trigram counts and the repetition term, one row per text; zeros for an empty one."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in enumerate(texts):
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        if not len(data):
            continue
        padded = np.concatenate([data, np.zeros(max(0, 3 - len(data)), np.uint8)]).astype(np.uint32)
        grams = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
        places = (grams * np.uint32(2654435761)) >> np.uint32(33 - BUCKETS.bit_length())
        out[row, :BUCKETS] = np.log1p(np.bincount(places, minlength=BUCKETS))
        lags = range(2, min(LAGS, len(data) // 2) + 1)
        alike = max((np.count_nonzero(data[d:] == data[:-d]) / len(data) for d in lags), default=0)
        out[row, BUCKETS + int(np.searchsorted(REPEAT_LIMITS, alike))] = 1
    return out


def _features(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    grams = _unit(rows[:, :BUCKETS] * weights)
    return _unit(np.concatenate([grams, REPEAT_WEIGHT * rows[:, BUCKETS:]], axis=1))


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.maximum(length, 1e-12)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    per_class: int = PER_CLASS,
    dimensions: int = DIMENSIONS,
    neighbours: int = NEIGHBOURS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    sample = labelled_sample(docs, labels, label_col, per_class, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = counts(batch.column(1).to_pylist()).astype(np.float16)
            data = pa.array([row.tobytes() for row in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], names=["label", "data"])

    # 2 * per_class rows of 4 KB, put in a fixed order
    rows = (
        sample.select("label", "text").mapInArrow(run, "label int, data binary").collect()
    )
    rows.sort(key=lambda r: (r["data"], r["label"]))
    seen = {
        r["label"]: r["n"]
        for r in labels.where(F.col(label_col).isin(0, 1))
        .groupBy(F.col(label_col).cast("int").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    total = sum(seen.values())
    share = seen.get(1, 0) / total if total else 0.5
    x = np.array([np.frombuffer(r["data"], np.float16) for r in rows], np.float32)
    y = np.array([r["label"] for r in rows], np.float32)
    if len(np.unique(y)) < 2:
        empty = np.zeros((0, dimensions), np.float32)
        nothing = np.zeros((TERMS, dimensions), np.float32)
        return Model(np.ones(BUCKETS, np.float32), nothing, empty, y[:0], share, neighbours)
    holders = (x[:, :BUCKETS] > 0).sum(axis=0)
    weights = np.log((1 + len(x)) / (1 + holders)).astype(np.float32) + 1
    x = _features(x, weights)
    values, vectors = np.linalg.eigh((x @ x.T).astype(np.float64))
    top = [i for i in np.argsort(values)[::-1][:dimensions] if values[i] > 1e-9]
    projection = (x.T @ (vectors[:, top] / np.sqrt(values[top]))).astype(np.float32)
    return Model(weights, projection, _unit(x @ projection), y, share, neighbours)


def vote(texts: list[str], model: Model) -> np.ndarray:
    """Scores of texts: the weighted share of label 1 among the nearest sample vectors."""
    out = np.full(len(texts), model.share)
    if not len(model.labels):
        return out
    # the sample's shares differ from those of all labelled rows
    own = model.labels.mean()
    worth = np.where(model.labels == 1, model.share / own, (1 - model.share) / (1 - own))
    near = min(model.neighbours, len(model.labels))
    for start in range(0, len(texts), BLOCK_ROWS):
        x = counts(texts[start : start + BLOCK_ROWS])
        some = x.any(axis=1)
        z = _unit(_features(x, model.weights) @ model.projection)
        cosines = z @ model.vectors.T
        best = np.argpartition(-cosines, near - 1, axis=1)[:, :near]
        nearest = np.take_along_axis(cosines, best, axis=1).astype(np.float64)
        weight = np.maximum(nearest, 1e-6) ** 8 * worth[best]
        score = (weight * model.labels[best]).sum(axis=1) / weight.sum(axis=1)
        out[start : start + BLOCK_ROWS] = np.where(some, score, model.share)
    return out


def score(
    docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score"
) -> DataFrame:
    """Adds the score of every document; the text column goes."""
    source = with_columns(docs, _text=text_of(text_col))
    gone = {text_col.lower(), "_text", score_col.lower()}
    rest = [f for f in source.schema.fields if f.name.lower() not in gone]
    out = T.StructType([*rest, T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = vote(batch.column("_text").to_pylist(), shared.value)
            columns = [batch.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, pa.float64())], names=[f.name for f in out.fields]
            )

    return source.select(*[f"`{f.name}`" for f in rest], "_text").mapInArrow(run, out)
