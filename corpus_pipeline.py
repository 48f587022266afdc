"""Corpus preparation over the documents table, stage by stage.

Each stage gets (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next stage's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.bpe import encode
from cotejo.llm.common import stored, with_columns
from cotejo.llm.decontaminate import decontaminate
from cotejo.llm.line_dedup import drop_lines, frequent_lines
from cotejo.llm.quality_rules import quality_rules
from cotejo.llm.queries import rank_file, table
from cotejo.llm.simhash import near_dedup, with_group
from cotejo.session import estimated_bytes


def _like(docs: DataFrame, changed: DataFrame, text_col: str | None = None) -> DataFrame:
    """The columns of docs, with another column as the text."""
    if text_col is None:
        return changed.select(*[f"`{c}`" for c in docs.columns])
    text = F.col(text_col)
    updated = with_columns(changed, _text=text, _n=F.length(text).cast("long"))
    values = {"text": F.col("_text"), "n_chars": F.col("_n")}
    return updated.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def clean_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject."""
    return _like(docs, quality_rules(docs).where("kept"), "clean_text")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go, from every document. Near copies, exact ones
    included, count as one document, so that a group of them keeps its content for the next stage."""
    grouped = with_group(docs, "near_group", size=4, bits=4)
    frequent = frequent_lines(
        grouped, min_docs=10, once_per=F.col("near_group"), size=estimated_bytes(docs)
    )
    return _like(docs, drop_lines(docs, frequent, min_chars=1), "kept_text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; documents are linked whose
    fingerprints over shingles of four words differ in four bits at most."""
    return _like(docs, near_dedup(docs, size=4, bits=4))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), size=10)
    return _like(docs, found.where(~F.col("contaminated")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether decoding them gives the text back."""
    ranks = rank_file()
    coded = encode(
        docs, ranks, public_tokenizers.PATTERN, blanks_split=True, decoded_col="decoded"
    )
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


STAGES = [
    ("quality_rules", clean_by_rules),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: SQL has neither the fingerprints nor the tokens; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
