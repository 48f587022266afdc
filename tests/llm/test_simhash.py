"""Fingerprints, the search for links, and components."""

import re
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cotejo.llm.common import row_key, text_of
from cotejo.llm.components import components
from cotejo.llm.simhash import (
    allocate,
    bit_statistics,
    correlated_groups,
    fingerprint,
    links,
    near_dedup,
    simhash_groups,
    text_fingerprints,
    with_group,
)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB é\t\n\x1c\x85", max_size=40))
def test_fingerprint_equals_plain_one(text):
    assert fingerprint(text, 4) % (1 << 64) == plain_fingerprint(text)


def test_fingerprints_in_sql_equal_plain_ones(make, sample_docs):
    texts = [None, "", " \t\n", "A", "b C", "a\x0bB\x0cc\r\nD", "É é\x1c\x85 x\u00a0y ÄÖ z w", "a b c d " * 9000]
    texts += [r["text"] for r in sample_docs.collect()]
    rows = [(i % 7, t) for i, t in enumerate(texts + texts[:20])]
    docs = make(rows)
    keys = docs.select("text", row_key(text_of("text")).alias("key"))
    got = keys.join(text_fingerprints(docs, 4), "key").select("text", "simhash").collect()
    assert len(got) == len(rows)
    assert all(r["simhash"] % (1 << 64) == plain_fingerprint(r["text"]) for r in got)
    pairs = [(f"{x} {y}",) for x in "aB" for y in "Cd"]
    found = text_fingerprints(make(pairs, "t string"), 2, "t").collect()
    assert {r["simhash"] % (1 << 64) for r in found} == {plain_fingerprint(t, 2) for (t,) in pairs}
    assert text_fingerprints(make([])).count() == 0


def least_reachable(near, names):
    """The smallest name in each component of a matrix of links."""
    label, before = list(range(len(names))), None
    while label != before:
        before = label
        label = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(names))]
    least = {}
    for i, root in enumerate(label):
        least[root] = min(least.get(root, names[i]), names[i])
    return [least[root] for root in label]


def test_groups_equal_brute_force(sample_docs):
    docs = sample_docs.collect()
    prints = np.array([plain_fingerprint(d["text"]) for d in docs], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    wanted = least_reachable(near, [d["doc_id"] for d in docs])
    got = {r["doc_id"]: r for r in simhash_groups(sample_docs).collect()}
    for doc, bits, least in zip(docs, prints.tolist(), wanted, strict=True):
        assert got[doc["doc_id"]]["fingerprint"] == f"{bits:016x}"
        assert got[doc["doc_id"]]["component_id"] == least


@pytest.mark.parametrize(("bits", "block"), [(4, 2048), (4, 16), (1, 8)])
def test_links_connect_what_all_pairs_would(make, bits, block):
    rng = np.random.default_rng(bits)
    found = {0, (1 << 64) - 1}
    for base in rng.integers(0, 1 << 63, 12):
        for _ in range(30):  # clusters that all fall into the same buckets
            x = int(base)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            found.add(x)
    prints = np.array(sorted(found), np.uint64)
    signed = [int(p) for p in prints.view(np.int64)]
    got = links(make([(p,) for p in signed], "simhash long"), bits, block)
    edges = [(r["a"], r["b"]) for r in got.collect()]
    assert all(bin((a ^ b) & ((1 << 64) - 1)).count("1") <= bits for a, b in edges)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits
    wanted = least_reachable(near, signed)
    root = {r["node"]: r["root"] for r in components(got).collect()}
    mine = [root.get(p, p) for p in signed]
    assert len(set(zip(mine, wanted, strict=True))) == len(set(mine)) == len(set(wanted))
    # a forest per way of filing and pair of blocks, never all pairs of a cluster
    assert len(edges) < 16 * len(signed)


def test_thresholds_add_up_and_cover_all_bits(make):
    rows = [(int(x),) for x in np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 500)]
    n, both = bit_statistics(make(rows, "simhash long"))
    assert n == 500
    for bits in range(6):
        plan = allocate(n, both, bits)
        assert all(t >= 0 for _, t in plan)
        assert len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan) <= 64
    for m in (1, 3, 5):
        groups = correlated_groups(n, both, m)
        assert sorted(b for g in groups for b in g) == list(range(64))


def test_components_of_chains_and_stars(make):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    got = components(make([*chain, *star, (7, 7), (500, 400)], "x long, y long")).collect()
    root = {r["node"]: r["root"] for r in got}
    assert len(root) == len(got)
    assert {root[i] for i in range(41)} == {0}
    assert {root[i] for i in range(100, 130)} == {100}
    assert root[500] == root[400] == 400
    assert components(make([], "x long, y long")).count() == 0


def test_groups_and_dedup_of_odd_rows(odd_docs, no_docs, make):
    text = " ".join(f"w{i}" for i in range(200))
    copies = make([(13, text), (11, text), (12, text), (19, "a text of its own kind")])
    docs = odd_docs.select("doc_id", "text").unionByName(copies)
    rows = simhash_groups(docs).collect()
    assert len(rows) == 12
    empty = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert sorted(r["doc_id"] for r in empty) == [1, 2, 3]
    assert {r["component_id"] for r in empty} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (11, 12, 13)} == {11}
    kept = Counter(r["doc_id"] for r in near_dedup(docs).collect())
    assert kept[4] == kept[1] == kept[11] == kept[19] == 1
    assert not {2, 3, 12, 13} & set(kept)
    assert simhash_groups(no_docs).count() == near_dedup(no_docs).count() == 0
    assert with_group(no_docs, "g").count() == 0
    assert allocate(0, np.zeros((64, 64)), 4) == []
    for one in ([(5, "a b c")], [(None, None)], [(None, None), (None, None)]):
        assert simhash_groups(make(one)).count() == len(one)
        assert near_dedup(make(one)).count() == 1


def test_groups_are_added_under_clashing_names(make):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", 7), (2, text.upper(), "b", 8), (3, "another text", "c", 9)]
    docs = make(rows, "doc_id long, text string, SimHash string, Root int")
    got = with_group(docs, "root")
    assert got.columns == ["doc_id", "text", "SimHash", "root"]
    group = {r["doc_id"]: r["root"] for r in got.collect()}
    assert group[1] == group[2] != group[3]
    assert sorted((r["doc_id"], r["Root"]) for r in near_dedup(docs).collect()) == [(1, 7), (3, 9)]


def test_dedup_keeps_different_documents_that_share_an_id(make):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 80)) for _ in range(8)]
    copy, other, *clean = texts
    rows = [(2, copy), (5, copy), (5, other), (5, other), *[(None, t) for t in clean], (None, copy)]
    kept = Counter((r["doc_id"], r["text"]) for r in near_dedup(make(rows)).collect())
    assert kept == Counter([(2, copy), (5, other), *[(None, t) for t in clean]])
