"""Token counts of texts, from batch encoding whose tokens never leave the worker.

The text column alone goes to the workers, as Arrow arrays, and one integer per text comes back.
A worker cuts the texts into pieces of a bounded size and encodes them in batches of about
``batch_bytes``, so that neither one long text nor many short ones decide how much memory a call
takes. A long text is cut at safe boundaries only: places where the tokenizer would start a new
word whatever stands around them, so that the tokens of the pieces are those of the text.

Results in the odd cases: NULL and the empty text have no bytes and no tokens; a text of white
space has none either; equal rows get equal rows; an empty table gives an empty table; columns of
the input that are called like an added one are replaced, in any case of their letters; a long text
without a safe boundary is one piece.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cotejo.llm.common import text_of, with_columns

#: Where a tokenizer that drops white space, takes digits one by one and letters and signs in runs
#: starts anew: before ASCII white space, between a letter and a digit or a sign that begins no
#: contraction and no special string, and between a digit and any ASCII character. No character
#: beside such a place takes part in a canonical composition across it.
SAFE = r"(?=[ \t\n\r\f\v])|(?<=[A-Za-z])(?=[0-9.,;:!?/_=+\-])|(?<=[0-9])(?=[!-~])"


def pieces(text: str, most: int, safe: re.Pattern) -> Iterator[str]:
    """The text in pieces of about ``most`` characters, cut at safe boundaries only."""
    start = 0
    while len(text) - start > most:
        found = safe.search(text, start + most)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


@lru_cache(maxsize=2)
def _tokenizer(content: str) -> Tokenizer:
    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def count_tokens(
    texts: list[str], tokenizer: Tokenizer, piece_chars: int, batch_bytes: int, safe: re.Pattern
) -> np.ndarray:
    """Tokens of each text. Batches hold pieces of about ``batch_bytes`` together."""
    counts = np.zeros(len(texts), dtype=np.int64)
    batch: list[str] = []
    owners: list[int] = []
    held = 0

    def encode() -> None:
        found = tokenizer.encode_batch_fast(batch, add_special_tokens=False)
        np.add.at(counts, owners, [len(x) for x in found])
        batch.clear()
        owners.clear()

    for owner, text in enumerate(texts):
        for piece in pieces(text, piece_chars, safe):
            size = len(piece) if piece.isascii() else len(piece.encode())
            if batch and held + size > batch_bytes:
                encode()
                held = 0
            if piece:
                batch.append(piece)
                owners.append(owner)
                held += size
    if batch:
        encode()
    return counts


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 2048,
    text_col: str = "text",
    piece_chars: int = 1 << 15,
    batch_bytes: int = 1 << 18,
    safe: str = SAFE,
) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) to every row.

    ``tokenizer``: the content of a file of the tokenizers library, a MB or two, sent to the workers
    once. ``safe`` must suit it: a pattern that matches the empty string where texts may be cut.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    @F.arrow_udf("long")
    def lengths(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder, boundary = _tokenizer(shared.value), re.compile(safe)
        for array in arrays:
            texts = array.to_pylist()
            yield pa.array(count_tokens(texts, encoder, piece_chars, batch_bytes, boundary))

    text = text_of(text_col)
    counted = with_columns(
        docs, n_bytes=F.octet_length(text).cast("long"), n_tokens=lengths(text)
    )
    return with_columns(counted, over_limit=F.col("n_tokens") > limit)
