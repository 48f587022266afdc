"""The pipeline against its operators' rules in plain Python."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_simhash import least_reachable, plain_fingerprint
from test_text_rules import LOWER, plain_hits

import corpus_pipeline
from cotejo.llm.bpe import parse_ranks
from cotejo.llm.queries import rank_file

FOLDER = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def near_groups(texts):
    """A number per text, the same for texts that links of four bits at most connect."""
    prints = np.array([plain_fingerprint(t, 4) for t in texts], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    return least_reachable(near, list(range(len(texts))))


def lines_by_groups(texts, groups, most):
    """The texts without lines that documents of ``most`` different groups hold."""
    def keys(text):
        return [x.strip(SPACE).translate(LOWER) for x in text.split("\n")]

    held = {}
    for text, group in zip(texts, groups, strict=True):
        for key in keys(text):
            held.setdefault(key, set()).add(group)
    return [
        "\n".join(
            line
            for line, key in zip(text.split("\n"), keys(text), strict=True)
            if not (key and len(held[key]) >= most)
        )
        for text in texts
    ]


def test_stages_change_what_they_say(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "byte_bpe",
    ]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}

    clean = spark.createDataFrame(stages["quality_rules"](spark, docs, FOLDER).collect(), docs.schema)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == columns and 0 < len(texts) < len(before)
    for doc_id, text in texts.items():
        lines = before[doc_id].split("\n")
        assert all(line in lines for line in text.split("\n"))
        assert len(before[doc_id].split()) >= 50

    lined = spark.createDataFrame(stages["line_dedup"](spark, clean, FOLDER).collect(), docs.schema)
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in lined.collect()}
    assert sorted(got) == ids
    wanted = lines_by_groups([texts[i] for i in ids], near_groups([texts[i] for i in ids]), 10)
    assert wanted != [texts[i] for i in ids]
    for doc_id, kept in zip(ids, wanted, strict=True):
        assert got[doc_id]["text"] == kept and got[doc_id]["n_chars"] == len(kept)

    single = stages["simhash_near_dedup"](spark, lined, FOLDER)
    single = spark.createDataFrame(single.collect(), docs.schema)
    group = near_groups([got[i]["text"] for i in ids])
    least = {g: min(i for i, h in zip(ids, group, strict=True) if g == h) for g in set(group)}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(least.values())

    items = [
        (r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    ]
    pure = spark.createDataFrame(
        stages["decontamination"](spark, single, FOLDER).collect(), docs.schema
    )
    assert pure.columns == columns
    kept = {r["doc_id"] for r in pure.collect()}
    for row in single.collect():
        assert (row["doc_id"] in kept) == (plain_hits(row["text"], items, 10)[1] == 0)

    library = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=parse_ranks(rank_file()),
        special_tokens={},
    )
    rows = stages["byte_bpe"](spark, pure, FOLDER).collect()
    by_id = {r["doc_id"]: r["text"] for r in pure.collect()}
    assert all(r["round_trip"] for r in rows)
    assert all(r["token_ids"] == library.encode_ordinary(by_id[r["doc_id"]]) for r in rows)


def test_stages_take_odd_rows(spark, make):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{i}" for i in range(3000)) + "."
    rows = [
        (1, None, None, None, None),
        (None, None, None, None, None),
        (2, "", "en", "s", 0),
        (None, long, "en", "s", 1),
        (None, long + " x", None, "s", 1),
        (3, long, "en", "s", 1),
        (3, long, "en", "s", 1),
    ]
    for docs in (make(rows, schema), make([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            found = out.collect()
            if name != "byte_bpe":
                assert out.columns == docs.columns
                assert len(found) <= docs.count()
                docs = spark.createDataFrame(found, docs.schema)


@pytest.mark.parametrize("name", ["quality_rules", "line_dedup", "decontamination"])
def test_stages_of_sql_only_run_no_python(spark, monkeypatch, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")

    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    for method in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), method, refused)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() and not re.search("Python|Pandas|Arrow", plan)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and all(r["round_trip"] for r in rows)
    assert max(Counter(r["doc_id"] for r in rows).values()) == 1
    assert all(re.fullmatch(r"\d+", str(r["n_tokens"])) for r in rows)


def test_shared_lines_go_and_near_copies_keep_one_page(make):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    legal = "All rights are reserved by the owners of this page."
    rng = np.random.default_rng(4)
    pages = [" ".join(f"w{x}" for x in rng.integers(0, 9999, 40)) + f"\n{legal}" for _ in range(12)]
    own = [" ".join(f"v{x}" for x in rng.integers(0, 9999, 60)) for _ in range(12)]
    copies = ["\n".join([legal, *own, f"Page number {i}."]) for i in range(14)]
    assert len(set(near_groups(pages + copies))) == 13
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(pages + copies)]
    stages, docs = dict(corpus_pipeline.STAGES), make(rows, schema)
    lined = stages["line_dedup"](None, docs, FOLDER)
    got = {r["doc_id"]: r["text"] for r in lined.collect()}
    cut = [t.replace(f"\n{legal}", "").replace(f"{legal}\n", "") for t in pages + copies]
    assert got == dict(enumerate(cut))
    kept = stages["simhash_near_dedup"](None, lined, FOLDER).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(13))
