"""Toxicity by a weighted finite-state grammar over clauses.

Words become letters: insult, threat, target, negation, report, other. Four transducers are
composed into one table of steps: negation weakens what follows it within a few words, reported
speech weakens the rest of its clause, a target near an insult or a threat strengthens it, and a
weigher turns the letters that come out into weights. A clause matches if its weight reaches a
limit; a document is scored by its strongest clause and by how many and what share of its clauses
match.

The insult words, and beginnings of words, are learned by Spark from a bounded sample of labelled
texts (``per_class`` rows of each label at most), and so are the words that stand near them oftener
than others, as further targets. Threats, targets, negations and reporting verbs start from lists
in four languages; of the threats those stay whose evidence in the sample is positive. The last
weights come from logistic regression, for which each half of the sample is scored with the words
learned from the other half.

Defined results: NULL counts as empty and has no clause; equal texts score alike; without labelled
rows of both kinds every score is the share of label 1 (0.5 without any); an empty table gives no
rows; a long text is read clause by clause; a column of the input that has the name of a result
column, in any case, is replaced by it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.llm.common import text_of, with_columns
from cotejo.llm.labelled import labelled_sample

PER_CLASS = 4000
LEXICON = 1000
#: Beginnings of words that may carry an insult in languages that build long words.
PREFIXES = (4, 5, 6, 7, 8)
MIN_HOLDERS = 5
MIN_EVIDENCE = 2.5
WORD_CACHE = 400_000

# Words of the grammar, in English, German, Spanish and French. A threat word that the
# labelled sample finds no likelier in toxic texts is left out, whatever it means elsewhere.
THREATS = frozenset(
    "kill hurt destroy murder shoot stab beat burn punch strangle hang die attack "
    "töten umbringen schlagen erschießen vernichten verletzen erwürgen verbrennen "
    "matar mataré golpear destruir quemar disparar ahorcar atacar "
    "tuer tuerai frapper détruire brûler étrangler pendre attaquer".split()
)
TARGETS = frozenset(
    "you your you're u ur yourself he she him her his they them their these those everyone "
    "du dich dir dein deine ihr euch euer er sie ihn ihm "
    "tú te ti usted ustedes vosotros él ella ellos ellas "
    "tu toi ton ta vous votre il elle ils elles lui leur".split()
)
NEGATIONS = frozenset(
    "not no never neither nor without isn't aren't wasn't weren't don't doesn't didn't won't "
    "can't cannot wouldn't shouldn't nicht kein keine keinen nie niemals ohne "
    "jamás nunca ningún ninguna sin ne pas jamais aucun aucune sans".split()
)
REPORTS = frozenset(
    "said says say wrote writes called calls quoted quotes reported reports claimed claims "
    "alleged according sagte sagt schrieb behauptete laut dijo dice escribió afirmó según "
    "dit disait écrit affirme selon".split()
)
#: Learned targets: so many at most, that often near an insult, and that much oftener than words are.
MOST_TARGETS = 200
TARGET_EVIDENCE = 1.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Letters that come out for an insult or a threat.
PLAIN, AIMED, WEAK = 0, 1, 2
REACH = 4
WEIGHTS = {PLAIN: 1.0, AIMED: 1.5, WEAK: 0.3}

PIECES = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]").findall


class Transducer:
    """A deterministic letter-to-letter transducer: (state, letter) -> (state, letter)."""

    def __init__(self, start, step) -> None:
        self.start = start
        self.step = step

    def after(self, first: Transducer) -> Transducer:
        """The composition: what ``first`` gives out is read by this one."""

        def step(state, letter):
            one, two = state
            one, between = first.step(one, letter)
            two, out = self.step(two, between)
            return (one, two), out

        return Transducer((first.start, self.start), step)


def _negation() -> Transducer:
    """Within reach of a negation, an insult or a threat becomes a weak one."""

    def step(left, letter):
        kind, _ = letter
        if kind == NEGATION:
            return REACH, letter
        if left and kind in (INSULT, THREAT):
            return left - 1, (kind, WEAK)
        return max(0, left - 1), letter

    return Transducer(0, step)


def _report() -> Transducer:
    """After a reporting verb the rest of the clause is weak."""

    def step(told, letter):
        kind, force = letter
        if kind in (INSULT, THREAT) and told:
            return told, (kind, WEAK)
        return told or kind == REPORT, (kind, force)

    return Transducer(False, step)


def _target() -> Transducer:
    """A target and a plain insult or threat within reach of each other make an aimed one."""

    def step(state, letter):
        since_target, since_hit = state
        kind, force = letter
        if kind == TARGET:
            return (REACH, 0), (kind, AIMED if since_hit else PLAIN)
        if kind in (INSULT, THREAT) and force == PLAIN:
            if since_target:
                return (since_target - 1, 0), (kind, AIMED)
            return (0, REACH), (kind, PLAIN)
        return (max(0, since_target - 1), max(0, since_hit - 1)), letter

    return Transducer((0, 0), step)


def _weigher() -> Transducer:
    """Factors by which the weight of a word counts; a target after a hit adds the difference."""

    def step(state, letter):
        kind, force = letter
        if kind == TARGET:
            return state, (WEIGHTS[AIMED] - WEIGHTS[PLAIN]) if force == AIMED else 0.0
        return state, WEIGHTS[force] if kind in (INSULT, THREAT) else 0.0

    return Transducer(0, step)


class Grammar:
    """The composed transducers as a table of numbered states, filled by walking it once."""

    def __init__(self) -> None:
        whole = _weigher().after(_target().after(_report().after(_negation())))
        numbers, todo = {whole.start: 0}, [whole.start]
        self.steps: list[list[tuple[int, float]]] = []
        while todo:
            row = []
            for kind in range(6):
                state, factor = whole.step(todo[0], (kind, PLAIN))
                if state not in numbers:
                    numbers[state] = len(numbers)
                    todo.append(state)
                row.append((numbers[state], factor))
            self.steps.append(row)
            todo.pop(0)

    def weight(self, letters: list[int], weights: list[float]) -> float:
        """The weight of a clause; a target strengthens the last word that had weight."""
        state, total, last = 0, 0.0, 0.0
        for letter, weight in zip(letters, weights, strict=True):
            state, factor = self.steps[state][letter]
            last = weight or last
            total += factor * (weight or last)
        return total


GRAMMAR = Grammar()


@dataclass
class Model:
    words: dict[str, float]
    prefixes: dict[str, float]
    weights: np.ndarray  # of the document's features
    share: float
    threats: frozenset[str] = THREATS
    targets: frozenset[str] = TARGETS
    _known: dict = field(default_factory=dict, repr=False)

    def letter(self, word: str) -> tuple[int, float]:
        """What a word is, and its weight; looked up once per worker."""
        found = self._known.get(word)
        if found is None:
            found = self._letter(word)
            if len(self._known) >= WORD_CACHE:
                self._known.clear()
            self._known[word] = found
        return found

    def _letter(self, word: str) -> tuple[int, float]:
        weight = self.words.get(word, 0.0)
        for n in PREFIXES:
            if len(word) >= n:
                weight = max(weight, self.prefixes.get(word[:n], 0.0))
        if word in self.threats:
            return THREAT, max(weight, 1.0)
        if weight:
            return INSULT, weight
        for words, kind in ((NEGATIONS, NEGATION), (REPORTS, REPORT), (self.targets, TARGET)):
            if word in words:
                return kind, 0.0
        return OTHER, 0.0


def clause_weights(text: str, model: Model) -> tuple[list[float], int]:
    """Weights of the clauses that have any, and the number of clauses."""
    weights: list[float] = []
    clauses, known, letter = 0, model._known, model.letter
    letters: list[tuple[int, float]] = []
    heavy = False
    for piece in PIECES(text.lower()):
        if piece in ".!?;\n":
            clauses += bool(letters)
            if heavy:
                weights.append(GRAMMAR.weight(*map(list, zip(*letters, strict=True))))
            letters, heavy = [], False
            continue
        found = known.get(piece) or letter(piece)
        letters.append(found)
        if found[1]:
            heavy = True
    clauses += bool(letters)
    if heavy:
        weights.append(GRAMMAR.weight(*map(list, zip(*letters, strict=True))))
    return weights, clauses


def features(text: str, model: Model) -> list[float]:
    weights, clauses = clause_weights(text, model)
    matched = [w for w in weights if w >= 1.0]
    total = sum(weights)
    return [
        1.0,
        max(weights, default=0.0),
        float(np.log1p(len(matched))),
        float(np.log1p(total)),
        len(matched) / clauses if clauses else 0.0,
    ]


def _terms(text: str) -> set[str]:
    words = {p for p in PIECES(text.lower()) if p not in ".!?;\n"}
    starts = {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}
    return words | starts


def _counted(sample: DataFrame) -> DataFrame:
    """Terms of the sample's texts with their evidence for label 1, counted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for label, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
            ):
                held[label].update(_terms(text))
            terms = list(held[0].keys() | held[1].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(terms, pa.string()),
                    pa.array([held[0][t] for t in terms], pa.int64()),
                    pa.array([held[1][t] for t in terms], pa.int64()),
                ],
                names=["term", "clean", "toxic"],
            )

    sizes = dict(sample.groupBy("label").agg(F.count(F.lit(1))).collect())
    evidence = F.log((F.col("toxic") + 0.5) / F.lit(sizes.get(1, 0) + 1.0)) - F.log(
        (F.col("clean") + 0.5) / F.lit(sizes.get(0, 0) + 1.0)
    )
    return (
        sample.select("label", "text")
        .mapInArrow(run, "term string, clean bigint, toxic bigint")
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .select("term", "toxic", evidence.alias("evidence"))
    )


def _lexicon(sample: DataFrame, size: int) -> tuple[dict[str, float], frozenset[str]]:
    """The terms that most lean to label 1, and the threats that do not lean to label 0."""
    strong = (F.col("toxic") >= MIN_HOLDERS) & (F.col("evidence") >= MIN_EVIDENCE)
    threat = F.col("term").isin(*THREATS)
    rows = (
        _counted(sample)
        .where(strong | threat)
        .orderBy(F.desc(strong), F.desc("evidence"), "term")
        .limit(size + len(THREATS))  # the size of the lexicon
        .collect()
    )
    leaning = [r for r in rows if r["toxic"] >= MIN_HOLDERS and r["evidence"] >= MIN_EVIDENCE]
    harmless = {r["term"] for r in rows if r["evidence"] <= 0}
    return {r["term"]: r["evidence"] for r in leaning[:size]}, THREATS - harmless


def near_hits(words: list[str], model: Model) -> list[bool]:
    """For each word of a clause, whether an insult or a threat stands within reach of it."""
    hits = [i for i, word in enumerate(words) if model.letter(word)[0] in (INSULT, THREAT)]
    near = [False] * len(words)
    for hit in hits:
        for i in range(max(0, hit - REACH), min(len(words), hit + REACH + 1)):
            near[i] = True
    return near


def _clauses(text: str) -> Iterator[list[str]]:
    words: list[str] = []
    for piece in PIECES(text.lower()):
        if piece in ".!?;\n":
            if words:
                yield words
            words = []
        else:
            words.append(piece)
    if words:
        yield words


def _learned_targets(sample: DataFrame, model: Model) -> frozenset[str]:
    """Words found near insults of the sample far oftener than words are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near: Counter = Counter()
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                for words in _clauses(text):
                    found.update(words)
                    near.update(w for w, hit in zip(words, near_hits(words, model), strict=True) if hit)
            terms = list(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(terms, pa.string()),
                    pa.array([near[t] for t in terms], pa.int64()),
                    pa.array([found[t] for t in terms], pa.int64()),
                ],
                names=["term", "near", "found"],
            )

    counts = (
        sample.select("text")
        .mapInArrow(run, "term string, near bigint, found bigint")
        .groupBy("term")
        .agg(F.sum("near").alias("near"), F.sum("found").alias("found"))
    )
    all_near, all_found = counts.agg(F.sum("near"), F.sum("found")).first()
    if not all_near:
        return frozenset()
    expected = F.col("found") * F.lit(all_near / all_found)
    evidence = F.log((F.col("near") + 0.5) / (expected + 0.5))
    rows = (
        counts.where(F.col("near") >= MIN_HOLDERS)
        .select("term", evidence.alias("evidence"))
        .where(F.col("evidence") >= TARGET_EVIDENCE)
        .orderBy(F.desc("evidence"), "term")
        .limit(MOST_TARGETS + LEXICON)  # insults are among them
        .collect()
    )
    words = [r["term"] for r in rows if model.letter(r["term"])[0] == OTHER]
    return frozenset(words[:MOST_TARGETS])


def _model(sample: DataFrame, size: int, share: float) -> Model:
    """The words learned from a sample, without the weights of the features."""
    terms, threats = _lexicon(sample, size)
    words = {t: w for t, w in terms.items() if t[-1] != "*"}
    prefixes = {t[:-1]: w for t, w in terms.items() if t[-1] == "*"}
    first = Model(words, prefixes, np.zeros(0), share, threats)
    targets = TARGETS | _learned_targets(sample, first)
    return Model(words, prefixes, np.zeros(0), share, threats, targets)


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    per_class: int = PER_CLASS,
    lexicon: int = LEXICON,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    sample = labelled_sample(docs, labels, label_col, per_class, id_col, text_col)
    half = F.pmod(F.xxhash64(F.lit(11), F.col("text")), F.lit(2))
    seen = {
        r["label"]: r["n"]
        for r in labels.where(F.col(label_col).isin(0, 1))
        .groupBy(F.col(label_col).cast("int").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    total = sum(seen.values())
    share = seen.get(1, 0) / total if total else 0.5
    nothing = Model({}, {}, np.zeros(0), share)
    if len(seen) < 2:
        return nothing
    rows = []
    for part in (0, 1):
        other = _model(sample.where(half != part), lexicon, share)

        def run(
            batches: Iterator[pa.RecordBatch], other: Model = other
        ) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [features(t, other) for t in batch.column(1).to_pylist()]
                x = pa.array(found, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["label", "x"])

        rows += (
            sample.where(half == part)
            .select("label", "text")
            .mapInArrow(run, "label int, x array<double>")
            .collect()  # at most 2 * per_class rows of five numbers
        )
    rows.sort(key=lambda r: (r["label"], r["x"]))
    y = np.array([r["label"] for r in rows], float)
    if len(np.unique(y)) < 2:
        return nothing
    model = _model(sample, lexicon, share)
    model.weights = _regress(np.array([r["x"] for r in rows]), y)
    # the sample's shares differ from those of all labelled rows
    own = y.mean()
    model.weights[0] += np.log(share / (1 - share)) - np.log(own / (1 - own))
    return model


def score_text(text: str, model: Model) -> float:
    if not len(model.weights):
        return model.share
    z = float(np.dot(features(text, model), model.weights))
    return 1 / (1 + float(np.exp(-min(30.0, max(-30.0, z)))))


def score(
    docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score"
) -> DataFrame:
    """Adds the score of every document; the text column goes."""
    source = with_columns(docs, _text=text_of(text_col))
    gone = {text_col.lower(), "_text", score_col.lower()}
    rest = [f for f in source.schema.fields if f.name.lower() not in gone]
    out = T.StructType([*rest, T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the lexicon's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score_text(t, shared.value) for t in batch.column("_text").to_pylist()]
            columns = [batch.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, pa.float64())], names=[f.name for f in out.fields]
            )

    return source.select(*[f"`{f.name}`" for f in rest], "_text").mapInArrow(run, out)
