"""Byte-level BPE against the library, decoding, and token shards."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cotejo.llm.bpe import Decoder, Encoder, Transducer, decode, encode, merge, parse_ranks
from cotejo.llm.queries import RANKS, rank_file
from cotejo.llm.token_shards import permute, read_slots, token_bytes, write_shards

DATA = rank_file(RANKS)
TABLE = parse_ranks(DATA)
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=TABLE, special_tokens={}
)
ENCODER = Encoder(TABLE, public_tokenizers.PATTERN, blanks_split=True)
DECODER = Decoder(TABLE)
TEXTS = st.lists(
    st.one_of(
        st.sampled_from(list("aeinorst .,'\n\t  ")),
        st.sampled_from(["é", "ß", "漢", "🙂", "́", "\x1c", "\x85", "\xa0", "²", "'s", "\r\n"]),
        st.characters(codec="utf-8"),
    ),
    max_size=80,
).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_batches_equal_the_library(texts):
    ids = ENCODER.batch(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [LIBRARY.encode_ordinary(t) for t in texts]
    assert DECODER.texts(ids).to_pylist() == texts


def test_batch_decoding_of_broken_characters():
    rows = [[], LIBRARY.encode_ordinary("漢字🙂é"), LIBRARY.encode_ordinary("🙂")[:-1], [0, 1]]
    rows += [rows[1][:-1] + rows[2], rows[2] * 3, None]
    found = DECODER.texts(pa.array(rows, pa.list_(pa.int32()))).to_pylist()
    wanted = [None if r is None else DECODER.data(r).decode("utf-8", "replace") for r in rows]
    assert found == wanted


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_equal_the_library(text):
    assert ENCODER.encode(text) == LIBRARY.encode_ordinary(text)
    assert DECODER.text(ENCODER.encode(text)) == text


@pytest.mark.parametrize("text", ["a" * 9001, "ab" * 6000, "漢" * 3000, " " * 5000, "xyzzy" * 2500])
def test_very_long_pieces_are_settled_on_the_way(text):
    assert ENCODER.encode(text) == LIBRARY.encode_ordinary(text)


def test_random_letters_and_small_tables():
    rng = random.Random(1)
    text = "".join(rng.choice("aeiouthxzqk") for _ in range(12_000))
    assert ENCODER.encode(text) == LIBRARY.encode_ordinary(text)
    small = Encoder(TABLE, public_tokenizers.PATTERN, True, max_pieces=3)
    small.transducer.max_steps = 40  # tables that are emptied again and again
    words = " ".join("".join(rng.choice("abct") for _ in range(6)) for _ in range(300))
    assert small.encode(words) == LIBRARY.encode_ordinary(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=5), max_size=12), st.binary(max_size=20))
def test_any_merge_table(tokens, data):
    """Tables whose ranks do not rise along the merges go by the merges themselves."""
    ranks = {bytes([b]): b for b in range(256)}
    for token in tokens:
        ranks.setdefault(token, len(ranks))
    made = {t for t in ranks if merge(t, ranks) == [t]}
    ranks = {t: r for t, r in ranks.items() if t in made}
    got = [Transducer(ranks).bytes_of[t] for t in Transducer(ranks).tokens(data)]
    assert b"".join(got) == data
    if len(ranks) == 256 + len([t for t in ranks if len(t) == 2]):  # merges of two bytes only
        assert got == merge(data, ranks)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50255), max_size=30))
def test_any_ids_decode_like_the_whole_bytes(ids):
    wanted = DECODER.data(ids).decode("utf-8", "replace")
    assert "".join(DECODER.stream(ids)) == DECODER.text(ids) == wanted


def test_a_character_is_given_out_when_complete():
    ids = [TABLE[bytes([b])] for b in "é漢🙂a".encode()]
    parts = list(DECODER.stream(ids))
    assert parts == ["é", "漢", "🙂", "a"]


def test_a_table_without_all_bytes_is_refused():
    with pytest.raises(ValueError, match="without a token"):
        Transducer({b"a": 0})


def test_columns_and_odd_rows(odd_docs, no_docs, make):
    clash = odd_docs.withColumn("token_ids", F.lit("x")).withColumn("_ids", F.lit(1))
    rows = encode(
        clash.drop("_ids"), DATA, public_tokenizers.PATTERN, True, decoded_col="decoded"
    ).collect()
    assert len(rows) == 8
    for row in rows:
        assert row["token_ids"] == LIBRARY.encode_ordinary(row["text"] or "")
        assert row["decoded"] == (row["text"] or "")
    again = decode(make([(1, [64, 65]), (2, None), (3, [])], "doc_id long, token_ids array<int>"), DATA)
    assert {r["doc_id"]: r["decoded"] for r in again.collect()} == {1: "ab", 2: None, 3: ""}
    assert encode(no_docs, DATA, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 64))
def test_permutation_and_its_inverse(n, key):
    numbers = np.arange(n)
    slots = permute(numbers, n, key)
    assert sorted(slots.tolist()) == numbers.tolist()
    assert (permute(slots, n, key, back=True) == numbers).all()


def test_shards_hold_every_sequence_once(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    data = docs.select("doc_id", F.col("text").cast("binary").alias("token_ids"))
    folder = f"file://{tmp_path}/bytes"
    placed = write_shards(data, folder, key=5, length=64, rows=100, dtype="uint8").collect()
    sequences = list(read_slots(folder))
    assert sorted(r["slot"] for r in placed) == list(range(len(sequences)))
    by_doc = {}
    for r in sorted(placed, key=lambda r: (r["doc_id"], r["seq_no"])):
        assert r["shard"] == r["slot"] // 100 and r["offset"] == r["slot"] % 100 * 64
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], b"") + sequences[r["slot"]][: r["n_tokens"]].tobytes()
    assert by_doc == {r["doc_id"]: bytes(r["token_ids"]) for r in data.collect()}
    later = list(read_slots(folder, 150, 260))
    assert [a.tobytes() for a in later] == [a.tobytes() for a in sequences[150:260]]


def test_shards_of_token_ids_and_odd_rows(spark, odd_docs, no_docs, tmp_path):
    ids = encode(odd_docs, DATA, public_tokenizers.PATTERN, True)
    folder = str(tmp_path / "ids")
    placed = write_shards(ids, folder, key=9, length=128, rows=50, pad=50256 % 65536).collect()
    sequences = list(read_slots(folder))
    assert len(sequences) == len(placed) and all(len(s) == 128 for s in sequences)
    short = next(r for r in placed if r["doc_id"] == 5)
    text = next(r["text"] for r in odd_docs.collect() if r["doc_id"] == 5)
    wanted = LIBRARY.encode_ordinary(text)
    assert sequences[short["slot"]][: short["n_tokens"]].tolist() == wanted
    assert set(sequences[short["slot"]][short["n_tokens"] :].tolist()) == {50256}
    assert not {r["doc_id"] for r in placed} & {1, 2}
    none = no_docs.select("doc_id", F.col("text").cast("binary").alias("token_ids"))
    assert write_shards(none, str(tmp_path / "none"), key=1, dtype="uint8").count() == 0


def test_shards_hold_the_ids_of_every_text(sample_docs, odd_docs, tmp_path):
    for n, docs in enumerate((sample_docs, odd_docs)):
        folder = str(tmp_path / str(n))
        ids = token_bytes(docs, DATA, public_tokenizers.PATTERN)
        placed = write_shards(ids, folder, key=3, length=64, rows=1000, dtype="uint16").collect()
        sequences = list(read_slots(folder))
        assert sorted(r["slot"] for r in placed) == list(range(len(sequences)))
        got = {}
        for r in sorted(placed, key=lambda r: r["seq_no"]):
            got.setdefault(r["doc_id"], []).append(sequences[r["slot"]][: r["n_tokens"]])
        for row in docs.collect():
            wanted = LIBRARY.encode_ordinary(row["text"] or "")
            if sum(r["doc_id"] == row["doc_id"] for r in docs.collect()) == 1:
                assert np.concatenate(got.get(row["doc_id"], [[]])).tolist() == wanted


def test_packed_sequences_hold_all_documents_in_order(spark, sample_docs, odd_docs, tmp_path):
    for n, docs in enumerate((sample_docs, odd_docs, sample_docs.limit(0))):
        folder, docs = str(tmp_path / str(n)), docs.coalesce(1)
        ids = token_bytes(docs, DATA, public_tokenizers.PATTERN)
        placed = write_shards(
            ids, folder, key=3, length=96, rows=100, pad=50256, separator=50256
        ).collect()
        sequences = list(read_slots(folder))
        assert sorted(r["slot"] for r in placed) == list(range(len(sequences)))
        stream, names = [], []
        # one input partition: the sequences in order are its documents one after the other
        assert len({r["seq_no"] for r in placed}) == len(placed)
        for r in sorted(placed, key=lambda r: r["seq_no"]):
            stream += sequences[r["slot"]][: r["n_tokens"]].tolist()
            names += [i for i in r["doc_id"] if not names or i is None or i != names[-1]]
        ends = np.flatnonzero(np.array(stream) == 50256) + 1
        found = Counter(tuple(x[:-1].tolist()) for x in np.split(stream, ends)[:-1])
        wanted = [LIBRARY.encode_ordinary(r["text"] or "") for r in docs.collect()]
        assert found == Counter(tuple(x) for x in wanted if x)
        assert sum(r["n_tokens"] < 96 for r in placed) <= 1
        assert set(names) == {r["doc_id"] for r in docs.collect() if r["text"]}
