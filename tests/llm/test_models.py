"""The language model against its definition, and the two scores on held-out labels."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cotejo.llm import kneser_ney, knn_quality, queries, toxicity
from cotejo.llm.labelled import labelled_sample, part_of

FOLDER = "/root/testdata/sf0.01"


def plain_model(texts, training):
    """Scores by counting in plain Python: tokens, known ones, base score and model score."""
    tokens = [(t or "").encode().lower().split() + [b"\n"] for t in texts]
    words, pairs = Counter(), Counter()
    for found, use in zip(tokens, training, strict=True):
        if use:
            words.update(found)
            pairs.update(zip([None, *found], found, strict=False))
    n, v = sum(words.values()), len(words)

    def discounts(counts):
        of = Counter(counts)
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        found = [k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0 for k in (1, 2, 3)]
        return [min(max(d, 0), k) for k, d in enumerate(found, 1)]

    high, before = discounts(pairs.values()), Counter(w for _, w in pairs)
    low, total = discounts(before.values()), sum(before.values())
    take = lambda c, by: by[min(c, 3) - 1]
    rest = sum(take(c, low) for c in before.values()) / total / (v + 1) if total else 1.0
    contexts = defaultdict(list)
    for (h, _), c in pairs.items():
        contexts[h].append(c)
    out = []
    for found in tokens:
        base = score = 0.0
        for h, w in zip([None, *found], found, strict=False):
            p = (before[w] - take(before[w], low)) / total + rest if w in before else rest
            if h in contexts:
                own, c = contexts[h], pairs.get((h, w), 0)
                left = sum(take(x, high) for x in own) / sum(own)
                p = (c - take(c, high) if c else 0) / sum(own) + left * p
            score += math.log10(p)
            base += math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1)))
        out.append((len(found), sum(words[w] > 0 for w in found), n, base, score))
    return out


def assert_plain_scores(docs, held, monkeypatch=None):
    model = kneser_ney.train(docs.where(~held))
    got = kneser_ney.score(docs.withColumn("held", held), model).collect()
    texts = {r["doc_id"]: (r["text"], r["held"]) for r in docs.withColumn("held", held).collect()}
    ids = sorted(texts)
    wanted = dict(
        zip(ids, plain_model([texts[i][0] for i in ids], [not texts[i][1] for i in ids]), strict=True)
    )
    for row in got:
        n, known, total, base, score = wanted[row["doc_id"]]
        assert (row["n_tokens"], row["n_known"], model.words.n_tokens) == (n, known, total)
        assert math.isclose(row["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(row["score"], score, rel_tol=1e-5, abs_tol=1e-4)


def test_model_equals_its_definition(sample_docs):
    assert_plain_scores(sample_docs.select("doc_id", "text"), part_of("doc_id", 10) == 0)


def test_many_shards_and_hot_words(sample_docs, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 20_000)  # sixteen shards and more
    monkeypatch.setattr(kneser_ney, "PIECE", 5_000)
    monkeypatch.setattr(kneser_ney, "BUFFER", 500)
    monkeypatch.setattr(kneser_ney, "HOT_SHARE", 0.01)
    assert_plain_scores(sample_docs.select("doc_id", "text"), part_of("doc_id", 10) == 0)


def test_model_on_odd_rows(make, odd_docs, no_docs):
    model = kneser_ney.train(odd_docs)
    rows = kneser_ney.score(odd_docs, model).collect()
    assert len(rows) == 8 and all(r["score"] <= 0 and r["n_tokens"] >= 1 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    empty = kneser_ney.train(no_docs)
    scores = kneser_ney.score(make([(1, "a b"), (2, None)]), empty).collect()
    assert [r["score"] for r in scores] == [0.0, 0.0]
    assert kneser_ney.score(no_docs, model).count() == 0
    clash = make([(1, "a b", "x", 2)], "doc_id long, text string, SCORE string, N_known int")
    named = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    assert kneser_ney.score(clash, model).columns == named


def test_words_are_split_like_bytes():
    texts = ["", " a\x0bB\x0c\x1cC\r\n", "É é\x85x\xa0y", "\t\n", "a a A"]
    words, at, counts = kneser_ney.split_words(pa.array(texts))
    words = [w.encode() for w in words.to_pylist()]
    found = [words[i] for i in at]
    assert [found[a:b] for a, b in itertools.pairwise(np.cumsum([0, *counts]))] == [
        t.encode().lower().split() for t in texts
    ]


def test_held_out_text_is_likelier_than_by_single_words(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    held = part_of("doc_id", 10) == 0
    model = kneser_ney.train(docs.where(~held))
    row = (
        kneser_ney.score(docs.where(held), model)
        .agg(F.sum("base_score").alias("base"), F.sum("score").alias("score"))
        .first()
    )
    assert row["score"] > row["base"]


def area(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1.0
    ones = labels.sum()
    return (order[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


@pytest.mark.parametrize(
    ("module", "label", "parts", "held", "least"),
    [(knn_quality, "quality", 3, 1, 0.95), (toxicity, "toxic", 5, 0, 0.85)],
)
def test_scores_tell_held_out_labels(spark, module, label, parts, held, least):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = part_of("doc_id", parts) == held
    model = module.fit(docs, labels.where(~out), label)
    rows = module.score(docs.where(out).join(labels, "doc_id"), model).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert area(np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])) >= least


def test_parts_are_those_of_the_checksum(make):
    rows = make([(i, "") for i in range(50)]).select("doc_id", part_of("doc_id", 5).alias("p"))
    assert all(r["p"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows.collect())


@pytest.mark.parametrize("module", [knn_quality, toxicity])
def test_scores_on_odd_rows(module, odd_docs, no_docs, make):
    kind = "quality" if module is knn_quality else "toxic"
    none = make([], f"doc_id long, {kind} int")
    model = module.fit(odd_docs, none)
    assert {r["score"] for r in module.score(odd_docs, model).collect()} == {0.5}
    labels = make([(1, 1), (5, 0), (5, 0), (None, 1), (4, None)], f"doc_id long, {kind} int")
    model = module.fit(odd_docs, labels)
    rows = module.score(odd_docs.withColumn("SCORE", F.lit("x")), model).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(no_docs, model).count() == 0


def test_sample_is_bounded_and_repeatable(make):
    docs = make([(i, str(i)) for i in range(100)])
    labels = make([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    first, again = (
        sorted(labelled_sample(docs, labels, "quality", 7).collect()) for _ in range(2)
    )
    assert first == again and Counter(r["label"] for r in first) == {0: 7, 1: 7}


def test_grammar_weighs_clauses():
    model = toxicity.Model({"idiot": 2.0, "scum": 1.0}, {"moro": 1.5}, np.zeros(0), 0.1)

    def weight(text):
        return toxicity.clause_weights(text, model)[0]

    assert weight("What an idiot.") == [2.0]
    assert weight("You idiot!") == [3.0] == weight("Idiot that you are!")
    assert weight("He is not an idiot.") == [pytest.approx(0.6)]
    assert weight("The paper said the word idiot.") == [pytest.approx(0.6)]
    assert weight("Not now. You moron") == [pytest.approx(2.25)]
    assert weight("I will kill you") == [1.5]
    assert weight("A clean clause; another one") == []
    assert toxicity.clause_weights("one. two! three\nfour", model)[1] == 4


def plain_clause(words, letter):
    """The weight of a clause from the places of its words."""
    kinds = [letter(w)[0] for w in words]
    weights = [letter(w)[1] for w in words]
    places = {k: [i for i, x in enumerate(kinds) if x == k] for k in range(6)}
    hits = sorted(places[toxicity.INSULT] + places[toxicity.THREAT])
    weak = {
        i for i in hits
        if any(1 <= i - j <= 4 for j in places[toxicity.NEGATION])
        or any(j < i for j in places[toxicity.REPORT])
    }
    aimed = {
        i for i in hits if i not in weak and any(1 <= i - j <= 4 for j in places[toxicity.TARGET])
    }
    total = sum(weights[i] * (0.3 if i in weak else 1.5 if i in aimed else 1.0) for i in hits)
    for t in places[toxicity.TARGET]:
        before = [i for i in hits if i not in weak and i not in aimed and 1 <= t - i <= 4]
        if before and not any(before[-1] < j < t for j in places[toxicity.TARGET]):
            total += 0.5 * [w for w in weights[:t] if w][-1]
    return total


def plain_toxicity(sample, halves, share, texts):
    """Words, weights and scores from the labelled texts, all counted here."""
    def pieces(text):
        return re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]", text.lower())

    def clauses(text):
        out = [[]]
        for piece in pieces(text):
            if piece in ".!?;\n":
                out.append([])
            else:
                out[-1].append(piece)
        return [c for c in out if c]

    def learn(rows):
        sizes, held = Counter(y for y, _ in rows), {0: Counter(), 1: Counter()}
        for y, text in rows:
            words = {w for c in clauses(text) for w in c}
            held[y].update(words | {w[:n] + "*" for w in words for n in range(4, 9) if len(w) >= n})
        proof = {
            t: math.log((held[1][t] + 0.5) / (sizes[1] + 1)) - math.log((held[0][t] + 0.5) / (sizes[0] + 1))
            for t in held[0] | held[1]
        }
        strong = [t for t in proof if held[1][t] >= 5 and proof[t] >= 2.5]
        strong = sorted(strong, key=lambda t: (-proof[t], t))[:1000]
        threats = {t for t in toxicity.THREATS if proof.get(t, 1) > 0}

        def letter(word, targets=toxicity.TARGETS):
            weight = max([proof[t] for t in [word, *(word[:n] + "*" for n in range(4, 9) if len(word) >= n)] if t in keep], default=0)
            if word in threats:
                return toxicity.THREAT, max(weight, 1.0)
            if weight:
                return toxicity.INSULT, weight
            for words, kind in ((toxicity.NEGATIONS, 4), (toxicity.REPORTS, 5), (targets, 3)):
                if word in words:
                    return kind, 0.0
            return 0, 0.0

        keep = set(strong)
        near, found = Counter(), Counter()
        for _, text in rows:
            for words in clauses(text):
                hits = [i for i, w in enumerate(words) if letter(w)[0] in (1, 2)]
                found.update(words)
                near.update(w for i, w in enumerate(words) if any(abs(i - j) <= 4 for j in hits))
        rate = sum(near.values()) / sum(found.values())
        lift = {w: math.log((near[w] + 0.5) / (found[w] * rate + 0.5)) for w in found if near[w] >= 5}
        more = sorted((w for w in lift if lift[w] >= 1 and letter(w)[0] == 0), key=lambda w: (-lift[w], w))
        targets = toxicity.TARGETS | set(more[:200])
        return lambda word: letter(word, targets)

    def features(text, letter):
        own = clauses(text)
        weights = [plain_clause(c, letter) for c in own if any(letter(w)[1] for w in c)]
        many = sum(w >= 1 for w in weights)
        return [1, max(weights, default=0), math.log1p(many), math.log1p(sum(weights)), many / len(own) if own else 0]

    x, y = [], []
    for part in (0, 1):
        letter = learn([r for r, h in zip(sample, halves, strict=True) if h != part])
        for (label, text), half in zip(sample, halves, strict=True):
            if half == part:
                x.append(features(text, letter))
                y.append(label)
    x, y = np.array(x), np.array(y)
    w = np.zeros(5)
    for _ in range(3000):  # plain gradient steps in Newton's metric at zero, until they end
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ x / 4 + np.eye(5), x.T @ (p - y) + w)
        w -= step
        if np.abs(step).max() < 1e-12:
            break
    w[0] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    letter = learn(sample)
    return [1 / (1 + math.exp(-np.dot(features(t, letter), w))) for t in texts]


def test_toxicity_query_equals_plain_counting(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where(part_of("doc_id", 5) != 0)
    half = F.pmod(F.xxhash64(F.lit(11), F.coalesce("text", F.lit(""))), F.lit(2)).alias("half")
    rows = docs.join(labels, "doc_id").select("toxic", "text", half).collect()
    assert 100 < len(rows) < toxicity.PER_CLASS
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sample = [(r["toxic"], r["text"] or "") for r in rows]
    share = sum(y for y, _ in sample) / len(sample)
    ids = sorted(texts)
    wanted = plain_toxicity(sample, [r["half"] for r in rows], share, [texts[i] for i in ids])
    got = {r["doc_id"]: r["score"] for r in queries.op6_toxicity(spark, FOLDER).collect()}
    assert [got[i] for i in ids] == pytest.approx(wanted, abs=1e-6)


def test_quality_query_equals_plain_neighbours(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where(part_of("doc_id", 3) != 1)
    rows = docs.join(labels, "doc_id").select("quality", "text").collect()
    share = np.mean([r["quality"] for r in rows])
    x = knn_quality.counts([r["text"] or "" for r in rows]).astype(np.float16).astype(np.float64)
    order = sorted(range(len(rows)), key=lambda i: (x[i].astype(np.float16).tobytes(), rows[i]["quality"]))
    x, y = x[order], np.array([rows[i]["quality"] for i in order])
    idf = np.log((1 + len(x)) / (1 + (x[:, :2048] > 0).sum(axis=0))) + 1

    def embedded(counts):
        grams = counts[:, :2048] * idf
        grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-12)
        both = np.concatenate([grams, 0.8 * counts[:, 2048:]], axis=1)
        return both / np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-12)

    _, sizes, axes = np.linalg.svd(embedded(x), full_matrices=False)
    axes = axes[:64][sizes[:64] ** 2 > 1e-9]

    def unit(v):
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    known = unit(embedded(x) @ axes.T)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in queries.op9_knn_quality(spark, FOLDER).collect()}
    worth = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    checked = 0
    for doc_id, text in texts.items():
        counts = knn_quality.counts([text]).astype(np.float64)
        cosines = (known @ unit(embedded(counts) @ axes.T)[0])
        best = np.argsort(-cosines, kind="stable")
        if not text or cosines[best[6]] - cosines[best[7]] < 1e-4:
            continue  # a tie may be broken either way
        weight = np.maximum(cosines[best[:7]], 1e-6) ** 8 * worth[best[:7]]
        assert got[doc_id] == pytest.approx((weight * y[best[:7]]).sum() / weight.sum(), abs=2e-3)
        checked += 1
    assert checked > 0.5 * len(texts)
