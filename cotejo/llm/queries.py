"""Queries over the test tables, one per operator, with the same result in SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm import kneser_ney, knn_quality, toxicity
from cotejo.llm.bpe import encode
from cotejo.llm.common import scratch_folder, stored
from cotejo.llm.conversation_repair import damaged, repair
from cotejo.llm.decontaminate import decontaminate
from cotejo.llm.labelled import part_of
from cotejo.llm.line_dedup import line_dedup
from cotejo.llm.quality_rules import quality_rules
from cotejo.llm.simhash import simhash_groups
from cotejo.llm.spelling_variants import spelling_variants, word_counts
from cotejo.llm.suffix_dedup import remove_repeats
from cotejo.llm.token_counts import token_counts
from cotejo.llm.token_shards import token_bytes, write_shards

RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")


def rank_file(name: str = RANKS) -> bytes:
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(table(spark, folder, "documents"), size=4, bits=4)


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, folder, "benchmark"), size=10)
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        _sha256(F.array_join(ids, ",")).alias("items_sha256"),
        "contaminated",
    )


#: An id of the vocabulary that no text has: it ends a document.
END_OF_TEXT = 50256


def op3_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of two bytes, documents one after the other in sequences of 2048, in shuffled
    training order."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ids = token_bytes(docs, rank_file(), public_tokenizers.PATTERN).drop("text")
    return write_shards(
        stored(ids, "tokens", compression="zstd"),
        scratch_folder(spark, "shards"),
        key=20240229,
        length=2048,
        rows=16_384,
        pad=END_OF_TEXT,
        separator=END_OF_TEXT,
    )


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return remove_repeats(docs, length=400).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", _sha256(F.col("kept_text")).alias("kept_sha256")
    )


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = part_of("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, folder, "labels").where(~held_out))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = part_of("doc_id", 10) == 0
    model = kneser_ney.train(docs.where(~held_out))
    return kneser_ney.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.words.n_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op9_knn_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = part_of("doc_id", 3) == 1
    model = knn_quality.fit(docs, table(spark, folder, "labels").where(~held_out))
    return knn_quality.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ranks = rank_file()
    coded = encode(
        docs, ranks, public_tokenizers.PATTERN, blanks_split=True, decoded_col="decoded"
    )
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        _sha256(F.array_join("token_ids", " ")).alias("ids_sha256"),
        _sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    tokenizer = rank_file("word_bpe_49k.json").decode()
    return token_counts(docs, tokenizer, limit=2048).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit"
    )


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spelling_variants(word_counts(docs, min_chars=7, min_count=2, damage=31), ratio=10)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair(damaged(table(spark, folder, "conversations")))


WORDS_SQL = r"""list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

OP2_SQL = r"""
WITH
  dw AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
    FROM documents),
  bw AS (
    SELECT item_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
    FROM benchmark),
  bn AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM bw WHERE len(ws) > 0),
  windows AS (
    SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS w
    FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bn)),
  sizes AS (SELECT DISTINCT n FROM windows),
  probes AS (
    SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
          FROM dw, sizes WHERE len(ws) >= n)),
  hits AS (SELECT doc_id, item_id, p.n, i FROM probes p JOIN windows w ON p.n = w.n AND p.w = w.w),
  covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits))
    GROUP BY doc_id),
  items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

KEY_SQL = (
    "translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), "
    "'[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

OP5_SQL = f"""
WITH
  cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  line AS (
    SELECT doc_id, lines[i] AS line, i
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM cut)),
  keyed AS (SELECT doc_id, i, line, {KEY_SQL} AS k FROM line),
  frequent AS (
    SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), ''))
         AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
GROUP BY doc_id
"""

OP8_SQL = r"""
WITH
  d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  w AS (SELECT doc_id, t, {words_t} AS ws FROM d),
  windows AS (
    SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
  twice AS (SELECT doc_id, k FROM windows GROUP BY doc_id, k HAVING count(*) > 1),
  repeats AS (
    SELECT doc_id, count(DISTINCT p) AS n
    FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows JOIN twice USING (doc_id, k))
    GROUP BY doc_id),
  lines AS (
    SELECT doc_id, line, len({words_line}) AS n,
           regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''),
                          '[\x20\x09-\x0D]+$', '') AS s
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
  judged AS (
    SELECT doc_id, line, n,
           n = 0 OR NOT (
             (n < 10 AND NOT regexp_matches(s, '[.!?…:;,"''”’»)\]]$'))
             OR length(s) - length(translate(s, '#*$%&|<>', '')) > n * 0.5
             OR len(regexp_extract_all(s, '[!?]{{2,}}')) > n * 0.5
             OR (length(s) - length(translate(s, '|»·•', '')) >= 3
                 AND length(s) - length(translate(s, '|»·•', '')) >= n * 0.25)
             OR (n <= 30 AND regexp_matches(lower(s), '{phrases}'))) AS ok
    FROM lines),
  by_doc AS (
    SELECT doc_id, coalesce(sum(n) FILTER (WHERE ok), 0) AS n_ok,
           count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup
    FROM judged GROUP BY doc_id),
  base AS (
    SELECT doc_id, t, ws, len(ws) AS n_words, coalesce(r.n, 0) AS n_rep, n_ok, n_dup,
           len(ws) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(ws) AS failed
    FROM w LEFT JOIN repeats r USING (doc_id) JOIN by_doc USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words,
       CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
       CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
       CAST(n_dup AS BIGINT) AS n_dup_lines, CAST(n_rep AS BIGINT) AS n_repeat_words,
       failed AS base_failed, NOT failed AND n_ok >= n_words * 0.5 AS kept
FROM base
"""


def _op8_sql() -> str:
    from cotejo.llm.quality_rules import BOILERPLATE

    return OP8_SQL.format(
        words_t=WORDS_SQL.format(text="t"),
        words_line=WORDS_SQL.format(text="line"),
        phrases="|".join(BOILERPLATE),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_shards": op3_token_shards,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_quality_rules": op8_quality_rules,
    "op9_knn_quality": op9_knn_quality,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_token_counts": op11_token_counts,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op8_quality_rules": _op8_sql(),
}
