"""Token counts against the tokenizer applied to each whole text."""

import re

import public_tokenizers
import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from cotejo.llm import queries
from cotejo.llm.token_counts import SAFE, _tokenizer, count_tokens, pieces, token_counts

CONTENT = open(public_tokenizers.path("word_bpe_49k.json")).read()
HARD = [
    "a<|endoftext|>b <|startoftext|>", "don't  we'll 'S it's 12ab3.4 x.'s a.'t", "<|END",
    "é é 12́ ́a 3⃣ ΑΣ ΑΣΑ ı İ", " a\x85b\xa0c", "x'll'd9'm1've", "①½²ab²c",
    "a-'s=b;'re", "a1<|endoftext|>2<|endoftext|", " ́x ̈y", "\x00﻿a", "漢字3かな.",
]


def expected(text: str) -> int:
    return len(_tokenizer(CONTENT).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("most", [1, 2, 5])
def test_pieces_have_the_tokens_of_the_text(most):
    found = count_tokens(HARD, _tokenizer(CONTENT), most, 16, re.compile(SAFE))
    assert found.tolist() == [expected(t) for t in HARD]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAs't.,<|>-1 2\n\tendofxé́Σ½漢"), max_size=40))
def test_any_cut_is_safe(text):
    assert "".join(pieces(text, 1, re.compile(SAFE))) == text
    assert count_tokens([text], _tokenizer(CONTENT), 1, 8, re.compile(SAFE)) == [expected(text)]


def test_query_equals_the_library(spark, sample_docs):
    texts = {r.doc_id: r.text for r in sample_docs.select("doc_id", "text").collect()}
    found = rows_of(queries.op11_token_counts(spark, "/root/testdata/sf0.001"))
    assert len(found) == len(texts)
    for row in found:
        text = texts[row["doc_id"]] or ""
        assert row["n_bytes"] == len(text.encode())
        assert row["n_tokens"] == expected(text)
        assert row["over_limit"] == (row["n_tokens"] > 2048)


def test_odd_rows_empty_table_and_clashing_names(make, odd_docs, no_docs):
    found = rows_of(token_counts(odd_docs, CONTENT, limit=5, piece_chars=100, batch_bytes=500))
    assert len(found) == 8
    for row in found:
        assert row["n_tokens"] == expected(row["text"] or "")
    clash = make([(1, "a b", "x", 2)], "doc_id long, text string, N_Tokens string, OVER_limit int")
    counted = token_counts(clash, CONTENT)
    assert counted.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    assert rows_of(counted.select("n_tokens", "over_limit")) == [{"n_tokens": 2, "over_limit": False}]
    assert rows_of(token_counts(no_docs, CONTENT)) == []
