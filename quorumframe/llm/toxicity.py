"""Toxicity by a grammar of weighted finite-state transducers over clauses.

A lexical transducer turns the words of a clause into symbols: hostile terms with their
weights, targets, negations, verbs of reported speech, words of intent. Four machines
are composed with it into one: a hostile term within the scope of an intent is a threat,
any other an insult; within the scope of a negation it is negated, after a verb of
speech reported, after a target targeted. Their arcs have weights, which multiply along
a path, and what the composed machine puts out are matched patterns, such as a targeted
threat. Clauses are scored by the weights of their patterns, and a logistic model turns
a document's clause scores into a probability.

Everything but the function words is learned from labelled documents: the hostile terms
(whole words, or openings that many words share), the weights of the arcs, by how much
more often than in clean documents each scope occurs in toxic ones, and those of the
patterns.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumframe.llm.common import materialise

# Function words of the four languages.
TARGETS = "you your yours he she they him her them du dich dir ihr euch sie tu toi vous il elle ils elles tú usted ustedes vosotros él ella ellos you're he's she's they're".split()
NEGATIONS = "not no never nor isn't aren't don't won't can't wasn't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún ni".split()
REPORTS = "said says claimed wrote called quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()
INTENTS = "will shall gonna going i'll we'll he'll she'll they'll you'll werde wirst wird werden vais va vas vont allons voy vamos van".split()

WORD, HOSTILE, TARGET, NEGATION, REPORT, INTENT, END = "word", "hostile", "target", "negation", "report", "intent", "end"
INSULT, THREAT = "insult", "threat"
SYMBOLS = (WORD, HOSTILE, TARGET, NEGATION, REPORT, INTENT, END)
SCOPES = ("plain", "targeted", "negated", "reported")
PATTERNS = tuple(product((INSULT, THREAT), SCOPES))
_PATTERN_AT = {p: k for k, p in enumerate(PATTERNS)}
#: What an arc of each scope weighs before anything is learned.
PRIOR = {THREAT: 1.5, "targeted": 1.25, "negated": 0.5, "reported": 0.6}

_OPENINGS = range(4, 9)
_CLAUSE_BYTES = bytes(10 if chr(b) in ".!?;:\n\r" else b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))
_MARKS = re.compile(rb"\xe2\x80[\x98\x9a\x9c-\x9f]|\xc2[\xab\xbb]")  # quotation marks beyond ASCII
_EDGE = re.compile(rb"(?<![0-9a-z\x80-\xff])'|'(?![0-9a-z\x80-\xff])")


def clauses_of(raw: bytes | None) -> list[list[bytes]]:
    """The words of each clause of UTF-8 text; an apostrophe stays only between two letters, quotation marks nowhere."""
    if not raw:
        return []
    if b"\xe2\x80" in raw or b"\xc2" in raw:
        raw = _MARKS.sub(b" ", raw.replace(b"\xe2\x80\x99", b"'"))
    text = raw.translate(_CLAUSE_BYTES)
    if b"'" in text:
        text = _EDGE.sub(b" ", text)
    return [words for clause in text.split(b"\n") if (words := clause.split())]


def parts_of(word: bytes) -> list[bytes]:
    """A word, and what stands on either side of its apostrophes."""
    return [word, *word.split(b"'")] if b"'" in word else [word]


@dataclass
class Transducer:
    """A deterministic weighted transducer; a missing arc stays in its state, copies the symbol and weighs one."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol) -> tuple[object, object, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


def compose(first: Transducer, second: Transducer, symbols) -> Transducer:
    """The machine that feeds the output of first into second; weights multiply."""
    start = (first.start, second.start)
    arcs, open_states, seen = {}, [start], {start}
    while open_states:
        state = open_states.pop()
        for symbol in symbols:
            a, middle, one = first.step(state[0], symbol)
            b, out, two = second.step(state[1], middle)
            arcs[state, symbol] = ((a, b), out, one * two)
            if (a, b) not in seen:
                seen.add((a, b))
                open_states.append((a, b))
    return Transducer(start, arcs)


def _intent(weight: float, scope: int = 4) -> Transducer:
    """Hostile terms become insults, and threats within so many words after an intent."""
    arcs = {}
    for left in range(scope + 1):
        arcs[left, INTENT] = (scope, WORD, 1.0)
        arcs[left, END] = (0, END, 1.0)
        for symbol in (WORD, TARGET, REPORT, NEGATION):
            arcs[left, symbol] = (max(0, left - 1), symbol, 1.0)
        arcs[left, HOSTILE] = (left, THREAT if left else INSULT, weight if left else 1.0)
    return Transducer(0, arcs)


def _negation(weight: float, scope: int = 3) -> Transducer:
    """Patterns within so many words after a negation are negated."""
    arcs = {}
    for left in range(scope + 1):
        arcs[left, NEGATION] = (scope, WORD, 1.0)
        arcs[left, END] = (0, END, 1.0)
        for symbol in (WORD, TARGET, REPORT):
            arcs[left, symbol] = (max(0, left - 1), symbol, 1.0)
        for kind in (INSULT, THREAT):
            arcs[left, kind] = (0, (kind, "negated" if left else "plain"), weight if left else 1.0)
    return Transducer(0, arcs)


def _reported(weight: float) -> Transducer:
    """Patterns after a verb of speech are reported, negated or not."""
    arcs = {(k, REPORT): (1, WORD, 1.0) for k in (0, 1)} | {(1, END): (0, END, 1.0)}
    for kind, scope in product((INSULT, THREAT), ("plain", "negated")):
        arcs[1, (kind, scope)] = (1, (kind, "reported"), weight)
    return Transducer(0, arcs)


def _targeted(weight: float) -> Transducer:
    """Plain patterns after a target are targeted."""
    arcs = {(k, TARGET): (1, WORD, 1.0) for k in (0, 1)} | {(1, END): (0, END, 1.0)}
    for kind in (INSULT, THREAT):
        arcs[1, (kind, "plain")] = (1, (kind, "targeted"), weight)
    return Transducer(0, arcs)


def grammar(arcs: dict[str, float]) -> Transducer:
    """The four machines as one, with these weights of their arcs."""
    machine = compose(_intent(arcs[THREAT]), _negation(arcs["negated"]), SYMBOLS)
    return compose(compose(machine, _reported(arcs["reported"]), SYMBOLS), _targeted(arcs["targeted"]), SYMBOLS)


@dataclass
class Model:
    """words, openings: log-odds of hostile terms. arcs: weights of the grammar. weights: of the features, the intercept first."""

    words: dict[bytes, float]
    openings: dict[bytes, float]
    arcs: dict[str, float]
    mean: list[float]
    scale: list[float]
    weights: list[float]


class Scorer:
    """The lexical transducer with its learned terms, in front of the grammar; what it says of a word is kept, within a bound."""

    def __init__(self, words: dict[bytes, float], openings: dict[bytes, float], arcs: dict[str, float], most: int = 1_000_000) -> None:
        self.words, self.openings, self.grammar, self.most = words, openings, grammar(arcs), most
        self.lengths = sorted({len(o) for o in openings})
        self.closed = {w.encode(): s for s, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTENT, INTENTS)) for w in ws}
        self.kept: dict[bytes, float] = {}

    def weight(self, word: bytes) -> float:
        found = self.kept.get(word)
        if found is None:
            found = max(max(self.words.get(part, 0.0), *(self.openings.get(part[:k], 0.0) for k in self.lengths), 0.0) for part in parts_of(word))
            if len(self.kept) >= self.most:
                self.kept.clear()
            self.kept[word] = found
        return found

    def symbol(self, word: bytes) -> tuple[str, float]:
        weight = self.weight(word)
        return (HOSTILE, weight) if weight > 0 else (self.closed.get(word, WORD), 0.0)

    def features(self, raw: bytes | None) -> np.ndarray:
        """Best clause, sum over clauses, matched clauses, and the weight of each pattern, in logarithms."""
        sums, best, total, matched = np.zeros(len(PATTERNS)), 0.0, 0.0, 0
        for words in clauses_of(raw):
            if not any(self.weight(w) > 0 for w in words):  # without a hostile term no pattern is put out
                continue
            state, score = self.grammar.start, 0.0
            for word in words:
                symbol, value = self.symbol(word)
                state, out, arc = self.grammar.step(state, symbol)
                if value:
                    score += value * arc
                    sums[_PATTERN_AT[out]] += value
            best, total, matched = max(best, score), total + score, matched + 1
        return np.log1p(np.concatenate([[best, total, matched], sums]))


def _score(features: np.ndarray, model: Model) -> np.ndarray:
    x = (features - np.array(model.mean)) / np.array(model.scale)
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -30, 30)))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def _terms(raw: bytes | None) -> set[tuple[bytes, bool]]:
    words = {part for clause in clauses_of(raw) for w in clause for part in parts_of(w)} - {b""}
    return {(w, False) for w in words} | {(w[:k], True) for w in words for k in _OPENINGS if len(w) >= k and _whole(w[:k])}


def _whole(part: bytes) -> bool:
    """Whether a cut at this place leaves whole characters."""
    return part.decode(errors="ignore").encode() == part


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bool, Counter] = {False: Counter(), True: Counter()}
    for batch in batches:
        for raw, toxic in zip(batch["text"].cast(pa.large_binary()).to_pylist(), batch["toxic"].to_pylist()):
            counts[toxic == 1].update(_terms(raw))
    for toxic, found in counts.items():
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([found[k] for k in keys], pa.int64()), pa.array([toxic] * len(keys), pa.bool_())],
            ["term", "opening", "n", "toxic"],
        )


def _training(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            rows = [scorer.features(raw).tolist() for raw in batch["text"].cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch["toxic"].cast(pa.int32())], ["x", "toxic"])

    return run


def learned_arcs(x: np.ndarray, y: np.ndarray, *, smooth: float = 20.0) -> dict[str, float]:
    """Weights of the arcs: how much a scope speaks for a toxic document, as a share of what a plain insult does.

    Both are log-odds of documents with and without the pattern, from 0 to twice the
    plain one; with few documents the weight stays near its prior.
    """
    held = x[:, 3:] > 0
    toxic, clean = y.sum(), len(y) - y.sum()

    def odds(patterns: list[int]) -> tuple[float, float]:
        has = held[:, patterns].any(axis=1)
        n1, n0 = has[y == 1].sum(), has[y == 0].sum()
        return math.log((n1 + 0.5) / (toxic + 1)) - math.log((n0 + 0.5) / (clean + 1)), float(n1 + n0)

    plain = max(0.1, odds([_PATTERN_AT[INSULT, "plain"]])[0])
    arcs = {}
    for name, prior in PRIOR.items():
        own, n = odds([k for p, k in _PATTERN_AT.items() if name in p])
        arcs[name] = (n * min(2.0, max(0.0, own / plain)) + smooth * prior) / (n + smooth)
    return arcs


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    design = np.column_stack([np.ones(len(x)), x])
    weights, penalty = np.zeros(design.shape[1]), ridge * np.diag([1e-3] + [1.0] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + penalty
        step = np.linalg.solve(hessian, design.T @ (y - p) - penalty @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def train(docs: DataFrame, labels: DataFrame, *, most_rows: int = 20_000, least_docs: int = 4, least_weight: float = 2.0, sample_files: int = 32) -> Model:
    """Learn from at most most_rows labelled documents, drawn by hash, none of them held out.

    All terms are known that at least least_docs of their toxic ones have and that weigh
    at least least_weight; so many documents bound how many there are.

    Labels that are null or neither 0 nor 1 take no part. Without labelled documents of
    both kinds the model knows no terms and gives every text the share of toxic labels (a
    half if there are none).
    """
    spark = docs.sparkSession
    ids = labels.where("doc_id is not null and toxic in (0, 1)").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")  # bounded by most_rows
    rows = materialise(rows.repartition(sample_files), "labelled")  # so the corpus is read once, not for every figure below
    totals = {r["toxic"] == 1: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(True, 0), totals.get(False, 0)
    width = 3 + len(PATTERNS)
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return Model({}, {}, PRIOR, [0.0] * width, [1.0] * width, [math.log(share / (1 - share))] + [0.0] * width)
    by = rows.mapInArrow(_counts, "term binary, opening boolean, n long, toxic boolean").groupBy("term", "opening").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("df1"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("df0"))
    weight = F.log((F.col("df1") + 0.5) / (n1 + 1)) - F.log((F.col("df0") + 0.5) / (n0 + 1))
    terms = by.where(F.col("df1") >= least_docs).withColumn("weight", weight).where(F.col("weight") >= least_weight).orderBy(F.desc(F.col("weight") * F.sqrt("df1")), "term", "opening").collect()  # of most_rows documents
    known = ({bytes(r["term"]): r["weight"] for r in terms if not r["opening"]}, {bytes(r["term"]): r["weight"] for r in terms if r["opening"]})

    def sample(arcs: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast((*known, arcs))
        found = rows.mapInArrow(_training(shared), "x array<double>, toxic int").collect()  # most_rows
        return np.array([r["x"] for r in found]), np.array([float(r["toxic"] == 1) for r in found])

    arcs = learned_arcs(*sample(PRIOR))
    x, y = sample(arcs)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    return Model(*known, arcs, mean.tolist(), scale.tolist(), _logistic((x - mean) / scale, y).tolist())


def _scores(batch: pa.RecordBatch, model: Model, scorer: Scorer) -> np.ndarray:
    raws = batch["text"].cast(pa.large_binary()).to_pylist()
    return _score(np.array([scorer.features(raw) for raw in raws]).reshape(len(raws), 3 + len(PATTERNS)), model)


def _scoring(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value.words, model.value.openings, model.value.arcs)
        for batch in batches:
            ids, scores = batch["doc_id"].to_pylist(), _scores(batch, model.value, scorer)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of docs.

    Null and empty texts get the score of a text without matches. Only doc_id and
    text are read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms of most_rows documents
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scoring(shared, threshold), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """Train on the labelled documents and score them all; see train and score."""
    return score(docs, train(docs, labels), threshold=threshold)


def _passing(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value.words, model.value.openings, model.value.arcs)
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, model.value, scorer) < threshold))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(_passing(model, threshold), docs.schema)
