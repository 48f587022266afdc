"""Spelling variants against a comparison of all words with all words."""

import re
import zlib
from collections import Counter

from conftest import rows_of

from cotejo.llm import queries
from cotejo.llm.count_trees import Tree, letters_of
from cotejo.llm.spelling_variants import near_words, part_splits, spelling_variants, word_counts


def words_by_hand(rows, least=7, times=2, damage=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % damage == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= least:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= times}


def near_by_hand(words):
    """Pairs that share a word with one place blanked or left out."""
    holes, out = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
            short = w[:i] + w[i + 1 :]
            if short in out:
                out[w].add(short)
                out[short].add(w)
    for group in holes.values():
        for w in group:
            out[w] |= group - {w}
    return out


def variants_by_hand(words):
    near, form = near_by_hand(words), {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def as_dict(df):
    rows = rows_of(df)
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_all_pairs(spark, sample_docs):
    rows = [(r.doc_id, r.text) for r in sample_docs.select("doc_id", "text").collect()]
    want = variants_by_hand(words_by_hand(rows))
    got = as_dict(queries.op12_spelling_variants(spark, "/root/testdata/sf0.001"))
    assert got == want
    assert any(v[0] for v in want.values())


def test_many_parts_give_the_same_pairs(spark, sample_docs):
    rows = [(r.doc_id, r.text) for r in sample_docs.select("doc_id", "text").collect()]
    words = words_by_hand(rows, least=4, times=1, damage=31)
    table = spark.createDataFrame(sorted(words.items()), "word string, n long").cache()
    splits, parts = part_splits(table, part_chars=400)
    assert parts > 50 and any(s.dims for s in splits.values())
    pairs = [(r["word"], r["near"], r["near_n"]) for r in rows_of(near_words(table, part_chars=400))]
    want = {(w, x, words[x]) for w, near in near_by_hand(words).items() for x in near}
    assert len(pairs) == len(want) and set(pairs) == want


def test_tree_of_equal_points_and_long_words():
    words = ["abcdefgh", "abcdefhg", "badcfehg", "hgfedcba", "abcdefgx", "aaaaaaaa", "aaaaaaab"]
    tree = Tree(words, leaf_size=1)
    who, at = tree.near(letters_of(words))
    found = {(words[i], words[j]) for i, j in zip(who, at, strict=True)}
    assert found == {(a, b) for a, bs in near_by_hand(dict.fromkeys(words, 1)).items() for b in bs}
    long = ["ab" * 500, "ab" * 499 + "ac", "ba" * 500]
    who, at = Tree(long).near(letters_of(long))
    assert sorted(zip(who.tolist(), at.tolist(), strict=True)) == [(0, 1), (1, 0)]
    assert len(Tree([]).near(letters_of(["abc"]))[0]) == 0


def test_chains_ties_and_odd_rows(make, odd_docs, no_docs):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "zaaaaab": 20}
    counts |= {"bbbbbbbb": 3, "bbbbbbb": 30, "bbbbbbbc": 30}
    table = make(list(counts.items()), "word string, n long")
    got = as_dict(spelling_variants(table))
    assert got == variants_by_hand(counts)
    assert got["aaaaaaa"][:2] == ("aaaaaab", "aaaabbb") and got["bbbbbbbb"][0] == "bbbbbbb"
    rows = [(r["doc_id"], r["text"]) for r in rows_of(odd_docs)]
    want = words_by_hand(rows, times=1)
    assert {r["word"]: r["n"] for r in rows_of(word_counts(odd_docs, min_count=1, damage=31))} == want
    for docs in (no_docs, make([(1, None), (None, "")])):
        assert rows_of(spelling_variants(word_counts(docs, damage=31))) == []
    clash = make([("abcdefg", 1)] * 3, "text string, Word int").selectExpr("1 AS doc_id", "*")
    assert as_dict(spelling_variants(word_counts(clash))) == {"abcdefg": (None, "abcdefg", 3, 0, None)}
