"""Quality rules, line dedup and decontamination."""

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cotejo.llm.decontaminate import decontaminate
from cotejo.llm.line_dedup import LineRuns, line_dedup
from cotejo.llm.quality_rules import Rules, quality_rules

SPACE = "\x20\t\n\x0b\x0c\r"


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_repeats(words):
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {
        i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (0, 1, 2)
    }
    return len(hit)


TEXTS = st.lists(
    st.text(alphabet="ab .|!\n\t#é", max_size=60), min_size=1, max_size=12
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=TEXTS)
def test_counts_equal_plain_ones(make, texts):
    got = quality_rules(make(enumerate(texts))).collect()
    for row in got:
        words = plain_words(row["text"])
        lines = [x for x in row["text"].split("\n") if plain_words(x)]
        assert row["n_words"] == len(words)
        assert row["word_chars"] == sum(map(len, words))
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in row["text"])
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == plain_repeats(words)


def test_rules_by_line(make):
    good = "A sentence of more than ten words that ends as it should end."
    cases = {
        "Home | News | Sport | About | Contact": False,
        "Menu entry": False,
        "Buy!! Now!! Here!!": False,
        "a $ b % c & d #": False,
        "All rights reserved.": False,
        good: True,
        "": True,
        "# A heading of a page that has more than ten words in it": True,
    }
    rows = quality_rules(make(enumerate(cases)), rules=Rules(min_words=0)).collect()
    for row, kept in zip(sorted(rows, key=lambda r: r["doc_id"]), cases.values(), strict=True):
        assert row["clean_text"] == (row["text"] if kept else ""), row["text"]


def test_document_that_loses_too_much_goes(make):
    noise = "\n".join(f"Link {i}" for i in range(200))
    repeating = "A sentence of some words that ends as it should end, plain and simple. " * 6
    assert [r["base_failed"] for r in quality_rules(make([(1, repeating)])).collect()] == [True]
    words = " ".join(f"word{i}" for i in range(80)) + "."
    rows = quality_rules(make([(1, words), (2, words + "\n" + noise)])).collect()
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rows}
    assert kept == {1: (False, True), 2: (False, False)}


def test_rules_on_odd_rows(odd_docs, no_docs):
    rows = quality_rules(odd_docs).collect()
    assert len(rows) == 8
    assert [r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert {r["n_words"] for r in rows if r["doc_id"] == 4} == {30_000}
    assert quality_rules(no_docs).count() == 0


def plain_line_dedup(texts, min_docs):
    keys = [[x.strip(SPACE).translate(LOWER) for x in (t or "").split("\n")] for t in texts]
    held = Counter(k for ks in keys for k in set(ks))
    out = []
    for text, ks in zip(texts, keys, strict=True):
        lines = (text or "").split("\n")
        kept = [x for x, k in zip(lines, ks, strict=True) if not (k and held[k] >= min_docs)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINES = st.lists(
    st.lists(st.sampled_from(["a", " A", "b\r", "", " ", "É", "é", "long line"]), max_size=5),
    min_size=1,
    max_size=12,
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(lines=LINES, min_docs=st.integers(1, 4))
def test_line_dedup_equals_plain_one(make, lines, min_docs):
    texts = ["\n".join(x) for x in lines]
    got = line_dedup(make(enumerate(texts)), min_docs=min_docs, batches=5, fan_in=2).collect()
    wanted = plain_line_dedup(texts, min_docs)
    for row in got:
        assert (row["n_lines"], row["n_dropped"], row["kept_text"]) == wanted[row["doc_id"]]


def test_line_dedup_on_odd_rows(make, odd_docs, no_docs):
    rows = line_dedup(odd_docs, min_docs=2).collect()
    assert len(rows) == 8
    by_id = {r["doc_id"]: r for r in rows}
    assert (by_id[1]["n_lines"], by_id[1]["n_dropped"], by_id[1]["kept_text"]) == (1, 0, "")
    assert (by_id[4]["n_dropped"], by_id[4]["kept_text"]) == (1, "")
    assert line_dedup(no_docs).count() == 0
    clash = make([(1, "a", 2, 3, 4)], "doc_id long, text string, _DROP int, _key int, Kept_Text int")
    row = line_dedup(clash, min_docs=1).first()
    assert (row["_DROP"], row["_key"], row["kept_text"], row["n_dropped"]) == (2, 3, "", 1)


def test_lines_count_once_per_group(make):
    rows = [(i, "shared\nown", i % 2) for i in range(6)] + [(9, "shared", 2)]
    docs = make(rows, "doc_id long, text string, grp int")
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup(docs, min_docs=3, once_per=F.col("grp")).collect()}
    assert got == {**dict.fromkeys(range(6), "own"), 9: ""}


def test_batches_meet_settled_hashes_and_merge_by_bucket(spark, make):
    runs = LineRuns(spark, min_docs=3, fan_in=2, buckets=4)
    lines = [((7, 7), i) for i in range(6)] + [((i, 1), i) for i in range(6)] + [((9, 9), 5)] * 3
    staged = runs.stage(make(lines, "h struct<h1:bigint,h2:bigint>, batch int"), 6)
    added = {}
    for run in staged:
        settled = bool(runs.settled)
        runs.add(run)
        added[run] = settled
    assert list(added.values()) == [False, False, True, True, True, True]
    # 7 is found in two batches, then in four: settled, and gone from the batches that follow
    late = runs.levels[1][-1:] + runs.levels.get(0, [])
    assert (7, 7) not in {(r["h1"], r["h2"]) for r in runs.read(late).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (runs.unsettled(runs.read(staged[-1:])), runs._merged(staged)):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(tuple(r) for r in runs.finish().collect()) == [(7, 7), (9, 9)]
    with pytest.raises(ValueError):
        LineRuns(spark, min_docs=0)


def plain_hits(text, items, size):
    def words(t):
        low = (t or "").translate(LOWER)
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    ws, hit, found = words(text), set(), set()
    for item, t in items:
        bs = words(t)
        n = min(size, len(bs))
        windows = {tuple(bs[i : i + n]) for i in range(len(bs) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1 if n else 0):
            if tuple(ws[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(ws), len(hit), sorted(found)


SENTENCES = st.lists(st.sampled_from(["a", "B", "b,", "c-d", "é", "1", "."]), max_size=14)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    docs=st.lists(SENTENCES, min_size=1, max_size=8),
    items=st.lists(SENTENCES, min_size=0, max_size=4),
    limit=st.sampled_from([0, 1000]),
)
def test_decontamination_equals_plain_one(make, docs, items, limit):
    texts = [" ".join(x) for x in docs]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)]
    got = decontaminate(
        make(enumerate(texts)), make(bench, "item_id long, text string"), size=4, broadcast_rows=limit
    ).collect()
    for row in got:
        n, hit, found = plain_hits(row["text"], bench, 4)
        assert (row["n_words"], row["n_hit"], sorted(row["item_ids"])) == (n, hit, found)
        assert row["contaminated"] == (hit > 0)
        # what is left of the text is its words outside the hits
        assert plain_hits(row["clean_text"], [], 4)[0] == n - hit


def test_spans_are_cut_out_of_the_text(make):
    bench = make([(7, "one two three four five")], "item_id long, text string")
    docs = make([(1, "Zero, ONE two\nthree four five! Six."), (2, "one two three")])
    rows = {r["doc_id"]: r for r in decontaminate(docs, bench, size=5).collect()}
    assert rows[1]["clean_text"] == "Zero, Six."
    assert rows[2]["clean_text"] == "one two three"


def test_decontamination_on_odd_rows(odd_docs, no_docs, make):
    bench = make(
        [(1, None), (None, "A text without an id"), (3, "")], "item_id long, text string"
    )
    rows = decontaminate(odd_docs, bench).collect()
    assert len(rows) == 8
    assert {r["doc_id"] for r in rows if r["contaminated"]} == {None}
    assert decontaminate(no_docs, bench).count() == 0
    empty = make([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate(odd_docs, empty).collect())


def test_decontamination_keeps_columns_of_any_name(make):
    schema = "doc_id long, text string, _hits int, _key int, row int, N_HIT int"
    docs = make([(1, "a b c d", 2, 3, 4, 5), (2, None, 6, 7, 8, 9)], schema)
    items = make([(7, "b c")], "item_id long, text string")
    found = decontaminate(docs, items, size=2)
    assert found.columns[:5] == ["doc_id", "text", "_hits", "_key", "row"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert (rows[1]["_hits"], rows[1]["row"], rows[1]["n_hit"], rows[1]["item_ids"]) == (2, 4, 2, [7])
    assert (rows[2]["_key"], rows[2]["n_hit"], rows[2]["contaminated"]) == (7, 0, False)
