"""Two-stage suffix sorting and the removal of repeated substrings."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cotejo.llm import suffix_dedup
from cotejo.llm.anchors import blocks
from cotejo.llm.arrays import find_sorted, manifest, mapped, write_sorted
from cotejo.llm.suffix_dedup import remove_repeats
from cotejo.llm.suffix_sort import adjacent_prefixes, classes, common_prefix, sorted_starts


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.binary(min_size=1, max_size=9), st.integers(0, 3)), min_size=1, max_size=7),
    st.integers(1, 7),
)
def test_suffixes_are_sorted(parts, length):
    strings = [bytes(b % 3 for b in body) + bytes(length - 1) + bytes([tail]) * 0 for body, tail in parts]
    runs = np.array([len(s) - length + 1 for s in strings])
    ends = np.cumsum([len(s) for s in strings])
    begins = ends - [len(s) for s in strings]
    data = b"".join(strings)
    order = sorted_starts(data, begins, runs, ends, length)
    assert sorted(order) == [b + i for b, r in zip(begins, runs, strict=True) for i in range(r)]
    keys = [data[p : p + length] for p in order]
    assert keys == sorted(keys)
    order = np.array(order, np.int64)
    shared = adjacent_prefixes(data, order, length).tolist()
    assert shared[1:] == [common_prefix(a, b) for a, b in zip(keys, keys[1:], strict=False)]
    of = classes(data, order, length).tolist()
    assert [a == b for a, b in zip(of, of[1:], strict=False)] == [
        common_prefix(a, b) >= length for a, b in zip(keys, keys[1:], strict=False)
    ]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    shared = bytes(rng.randrange(97, 123) for _ in range(900))
    texts = [bytes(rng.randrange(97, 123) for _ in range(300)) + shared, shared + b"tail", b"", b"x"]
    number, first, last, anchor, group = blocks(texts, 400)
    base = [0, 1200]
    held = [{}, {}]
    for n, a, z, p, g in zip(number, first, last, anchor, group, strict=True):
        for s in range(a, z + 1):
            held[n][s - base[n]] = (p - s, g)
    for s in range(900 - 400 + 1):
        assert held[0][300 + s] == held[1][s]
    assert len(held[0]) == 1200 - 399 and len(held[1]) == 904 - 399


def plain_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    held = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if held[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        spans = [tuple(x) for x in edges.reshape(-1, 2).tolist()]
        out.append((bytes(b for b, g in zip(d, gone, strict=True) if not g), len(d), spans))
    return out


def assert_plain(df, texts, length, **how):
    wanted = plain_removal(texts, length)
    for row in remove_repeats(df, length=length, **how).collect():
        kept, n, spans = wanted[row["doc_id"]]
        assert bytes(row["kept"]) == kept
        assert (row["n_bytes"], row["n_removed"]) == (n, n - len(kept))
        assert [(s["begin"], s["end"]) for s in row["spans"]] == spans


@pytest.mark.parametrize(("group", "shard_docs"), [(4096, 1 << 14), (2, 3)])
def test_removal_equals_brute_force(make, monkeypatch, group, shard_docs):
    monkeypatch.setattr(suffix_dedup, "SHARD_DOCS", shard_docs)
    rng = random.Random(group)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(3)]
    texts = []
    for i in range(40):
        text = " ".join(word() for _ in range(rng.randint(0, 120)))
        if i % 2:  # passages cut at different places, some with a changed word
            words = rng.choice(passages).split()
            words = words[rng.randint(0, 9) :]
            if i % 5 == 0:
                words[30] = "changed"
            text = text[: rng.randint(0, len(text))] + " ".join(words) + text[-9:]
        texts.append(text)
    texts += [texts[1], texts[1], "x" * 700, "xy" * 300, "y" + "x" * 300, "", None, "short"]
    assert_plain(make(list(enumerate(texts))), texts, 128, group=group)


def test_removal_from_the_given_texts(sample_docs):
    rows = sample_docs.orderBy("doc_id").collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    ids = sorted(texts)
    wanted = dict(zip(ids, plain_removal([texts[i] for i in ids], 400), strict=True))
    for row in remove_repeats(sample_docs).collect():
        assert bytes(row["kept"]) == wanted[row["doc_id"]][0]
        assert len(row["spans"]) == len(wanted[row["doc_id"]][2])


def test_removal_on_odd_rows(odd_docs, no_docs):
    rows = remove_repeats(odd_docs.withColumnRenamed("n_words", "spans"), length=200).collect()
    assert len(rows) == 8
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[4]["n_removed"] == by_id[4]["n_bytes"] and len(by_id[4]["spans"]) == 1
    assert (by_id[1]["n_bytes"], by_id[1]["spans"]) == (0, [])
    assert remove_repeats(no_docs).count() == 0
    clash = odd_docs.select("doc_id", "text", F.lit(1).alias("KEPT"), F.lit(2).alias("N_bytes"))
    assert remove_repeats(clash).columns == ["doc_id", "kept", "n_bytes", "n_removed", "spans"]
    with pytest.raises(ValueError):
        remove_repeats(odd_docs, length=100)


def test_groups_spread_over_shards(sample_docs):
    texts = [(r["text"] or "").encode() for r in sample_docs.collect()]
    groups = np.unique(blocks(texts, 400)[4])
    held = np.bincount(groups >> 59, minlength=16)
    assert len(groups) > 200 and held.max() < 3 * held.mean() and held.min() > 0


def test_a_lost_shard_is_an_error(make, tmp_path):
    rows = make([(i << 58, i) for i in range(20)], "h long, v long")
    folder = str(tmp_path)
    write_sorted(rows, folder, 3, "some")
    assert sum(manifest(folder, "some").values()) == 20
    wanted = np.arange(32, dtype=np.int64)[:20] << 58

    def values():
        return sorted(
            x for _, low, high, a in find_sorted(folder, 3, "some", ["h", "v"], wanted)
            for i, j in zip(low, high, strict=True) for x in a[1][i:j].tolist()
        )

    assert values() == list(range(20))
    mapped.cache_clear()
    (tmp_path / f"some-v-{max(manifest(folder, 'some'))}").unlink()
    with pytest.raises(FileNotFoundError):
        values()
