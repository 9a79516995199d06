"""Toxicity: a weighted finite-state pattern grammar over clauses.

A lexical transducer turns words into symbols: insult, threat, target, negation, reporting verb, boundary, other. Small
transducers for reported speech, negation, targets and threats are composed into one, which rewrites the symbols and
weighs them: an insult after a target counts for more, a negated or reported one for less, a threat only with a target.
A matched clause scores the sum of its terms' weights under the path's weight; documents are scored from their clauses.

Which words insult, and how much each tells, is learned from labelled rows, beside a few fixed words: words and word
beginnings that set apart the toxic rows, by log-odds, each toxic row being covered several times. A logistic model over
the clause scores gives the score. Only texts and labels of training rows are used, and of them a sample of at most
`per_class` rows a class, picked by a hash of the id.

Null texts score like empty ones; long texts count whole; repeated rows and ties score alike. Rows without labels, null
labels and extra columns do not matter; a document labelled more than once counts once for each label. An empty table
stays empty. Without both classes in training, scores come from the fixed words alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, small_batches

INSULTS = "idiot moron stupid loser clown scum trash pathetic worthless disgusting imbecile vermin".split()
#: Of English, German, French and Spanish, a line each.
THREATS = """kill hurt destroy beat burn shoot stab strangle punch crush
    töten töte umbringen erschlagen schlagen vernichten zerstören verprügeln erschießen erwürgen
    tuer tuerai frapper détruire brûler étrangler poignarder écraser
    matar mataré golpear destruir quemar apuñalar estrangular aplastar""".split()
TARGETS = """you your yours u he she they them him her his their these those this that such
    du dich dir dein deine deinen deinem deiner ihr euch euer eure er sie ihn ihm ihnen diese dieser dieses solche
    tu te toi ton ta tes vous votre vos il elle ils elles lui leur leurs cet cette ces
    tú ti tus usted ustedes vosotros vuestro él ella ellos ellas su sus ese esa esos esas este esta estos""".split()
NEGATIONS = """not no never isn't aren't wasn't don't doesn't didn't neither nor without hardly
    nicht kein keine keinen keinem keiner nie niemals weder ohne kaum
    pas jamais aucun aucune sans guère
    nunca jamás ningún ninguna ninguno tampoco sin""".split()
REPORTS = """said says say claimed claims wrote writes reported reports quoted quotes called according alleged
    sagte sagt sagten behauptete behauptet schrieb schreibt berichtete berichtet zitierte nannte laut angeblich
    dit disait affirme affirmait écrit écrivait rapporte selon cite prétend
    dijo dice dijeron afirma afirmó escribió escribe informó según citó""".split()
_FIXED = {w: s for s, ws in (("h", THREATS), ("t", TARGETS), ("n", NEGATIONS), ("r", REPORTS)) for w in ws}

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
_STEMS = (4, 5, 6)
FEATURES = 4


@dataclass
class Transducer:
    """A deterministic transducer; arcs: (state, symbol) to (state, symbol, weight); others keep state and symbol."""

    arcs: dict = field(default_factory=dict)
    fallback: dict = field(default_factory=dict)  # state to next state, for symbols without an arc
    start: int = 0

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol)) or (self.fallback.get(state, state), symbol, 0.0)

    def states(self) -> set[int]:
        return {self.start, *(s for s, _ in self.arcs), *(a[0] for a in self.arcs.values()), *self.fallback, *self.fallback.values()}


def compose(a: Transducer, b: Transducer, symbols: str) -> Transducer:
    """First a, then b on what a writes; weights add up. States are numbered as they are reached."""
    numbers = {(a.start, b.start): 0}
    out, todo = Transducer(), [(a.start, b.start)]
    while todo:
        s, t = todo.pop()
        for x in symbols:
            s2, y, w = a.step(s, x)
            t2, z, v = b.step(t, y)
            if (s2, t2) not in numbers:
                numbers[s2, t2] = len(numbers)
                todo.append((s2, t2))
            out.arcs[numbers[s, t], x] = (numbers[s2, t2], z, w + v)
    return out


#: Symbols: i insult, h threat, t target, n negation, r report, b boundary, o other; D directed insult, N negated, K threat at a target.
SYMBOLS = "ihtnrboDNK"


def _after(trigger: str, reach: int, rewrite: dict[str, tuple[str, float]]) -> Transducer:
    """For `reach` symbols after the trigger, rewrite; a boundary ends it."""
    out = Transducer(fallback={k: k - 1 for k in range(1, reach + 1)})
    for k in range(reach + 1):
        out.arcs[k, trigger] = (reach, trigger, 0.0)
        out.arcs[k, "b"] = (0, "b", 0.0)
        if k:
            out.arcs |= {(k, x): (k, y, w) for x, (y, w) in rewrite.items()}
    return out


def grammar() -> Transducer:
    """Reported speech, then negation, then targets, then threats."""
    reported = Transducer(arcs={(0, "r"): (1, "r", 0.0), (1, "b"): (0, "b", 0.0), (1, "i"): (1, "i", -0.7), (1, "h"): (1, "h", -0.7)})
    negated = _after("n", 3, {"i": ("N", -1.2), "h": ("o", 0.0)})
    directed = _after("t", 3, {"i": ("D", 0.3)})
    threats = _after("h", 3, {"t": ("K", 0.0)})
    out = reported
    for part in (negated, directed, threats):
        out = compose(out, part, SYMBOLS)
    return out


class Scorer:
    """Clause scores of a text, under learned term weights."""

    def __init__(self, terms: dict[str, float]) -> None:
        self.words = {t: w for t, w in terms.items() if not t.endswith("*")}
        self.stems = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.grammar = grammar()
        self._known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = self._known.get(word)
        if w is None:
            w = max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in _STEMS if len(word) >= k)])
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[word] = w
        return w

    def features(self, text: str) -> list[float]:
        """Sum of clause scores (log), best clause, share of matched clauses, matched clauses (log)."""
        low = text.lower()
        if not any(self.weight(w) or w in _FIXED and _FIXED[w] == "h" for w in set(_WORD.findall(low))):
            return [0.0] * FEATURES
        state, clause, scores, clauses = self.grammar.start, 0.0, [], 1
        for token in _TOKEN.findall(low):
            weight = 0.0
            if len(token) == 1 and not token.isalpha():
                symbol = "b"
            elif weight := self.weight(token):
                symbol = "i"
            else:
                symbol = _FIXED.get(token, "o")
            state, out, path = self.grammar.step(state, symbol)
            if out in "iDN":
                clause += weight * math.exp(path)
            elif out == "K":
                clause += 3.0 * math.exp(path)
            elif symbol == "b":
                clauses += 1
                if clause:
                    scores.append(clause)
                    clause = 0.0
        if clause:
            scores.append(clause)
        total = sum(scores)
        return [math.log1p(total), max(scores, default=0.0) / 5.0, 10 * len(scores) / clauses if clauses > 3 else len(scores) / 2.0, math.log1p(len(scores))]


@dataclass
class Model:
    terms: dict[str, float]
    bias: float
    weights: list[float]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.bias + features @ np.array(self.weights)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _doc_terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in _STEMS if len(w) >= k}


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the first weight is the bias."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * len(y) * np.r_[0, beta[1:]] / 100
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(x.shape[1]) * ridge * len(y) / 100
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 5000, cover: int = 3) -> Model:
    """Learn from at most per_class labelled rows of either class. labels: training rows only."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    fallback = Model({w: 5.0 for w in INSULTS}, -4.0, [1.5, 1.0, 0.5, 0.5])
    if len(sizes) < 2:
        return fallback
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # at most 2 * per_class ids are broadcast
    sample = materialize(docs.select(F.col(id_col).alias("_id"), text.alias("t")).join(F.broadcast(picked), "_id").select("t", "y").repartition(8), "labelled")

    def count_terms(batches):
        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found.update(_doc_terms(t))
        items = list(found.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["term", "n"])

    toxic = sample.where("y = 1")
    n_sample = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n_sample) < 2:
        return fallback
    least = max(3, round(0.004 * n_sample[1]))
    counted = toxic.select("t").mapInArrow(count_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    terms = sorted({*(r.term for r in counted.select("term").collect()), *INSULTS})  # of the sample's texts
    numbers = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def incidence(batches):
        for batch in batches:
            rows = [np.array(sorted(numbers.value[t] for t in _doc_terms(x) if t in numbers.value), dtype="<i4").tobytes() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.binary())], names=["y", "terms"])

    has = {0: np.zeros(len(terms)), 1: np.zeros(len(terms))}
    toxic_rows = []
    for y, blob in sample.mapInArrow(incidence, "y int, terms binary").toLocalIterator():
        at = np.frombuffer(blob, dtype="<i4")
        has[y][at] += 1
        if y == 1:
            toxic_rows.append(at)
    odds = np.log((has[1] + 0.5) / (n_sample[1] + 1)) - np.log((has[0] + 0.5) / (n_sample[0] + 1))
    chosen = _choose(terms, odds, toxic_rows, cover, least)
    weights = {terms[i]: float(odds[i]) for i in chosen}
    for w in INSULTS:
        weights.setdefault(w, max(3.0, float(odds[terms.index(w)])) if has[1][terms.index(w)] + has[0][terms.index(w)] < 3 else max(0.0, float(odds[terms.index(w)])))
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer(weights))

    def measure(batches):
        for batch in batches:
            rows = [scorer.value.features(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["y", "f"])

    rows = sample.mapInArrow(measure, "y int, f array<double>").collect()
    x, y = np.array([r.f for r in rows], dtype=float).reshape(-1, FEATURES), np.array([r.y for r in rows], dtype=float)
    share = np.where(y == 1, sizes[1] / n_sample[1], sizes[0] / n_sample[0])
    beta = _logistic(x, y, share * len(y) / share.sum())
    return Model(weights, float(beta[0]), [float(b) for b in beta[1:]])


def _choose(terms: list[str], odds: np.ndarray, toxic_rows: list[np.ndarray], cover: int, least: int) -> list[int]:
    """Terms, best first, until every toxic row has `cover` of them or no term with enough new rows is left."""
    fit_for = odds >= 2.0
    if not toxic_rows or not fit_for.any():
        return []
    flat = np.concatenate(toxic_rows)
    row = np.repeat(np.arange(len(toxic_rows)), [len(r) for r in toxic_rows])
    keep = fit_for[flat]
    flat, row = flat[keep], row[keep]
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    bounds = np.searchsorted(flat, np.arange(len(terms) + 1))
    need = np.full(len(toxic_rows), cover)
    out: list[int] = []
    taken = np.zeros(len(terms), bool)
    while True:
        gain = np.bincount(flat, weights=need[row] > 0, minlength=len(terms))
        gain[taken | ~fit_for] = 0
        best = int(np.argmax(gain * odds))
        if gain[best] < least:
            break
        taken[best] = True
        out.append(best)
        need[row[bounds[best] : bounds[best + 1]]] -= 1
        # a word that a chosen beginning covers adds nothing of its own
        t = terms[best]
        if t.endswith("*"):
            taken |= np.array([x.startswith(t[:-1]) for x in terms])
    return out


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with one more column, the score from 0 to 1; one of that name is replaced."""
    held, own = fresh("text", [*docs.columns, score_col]), F.col(text_col).cast("string")
    rows = docs.withColumn(held, own).drop(score_col)
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((Scorer(model.terms), model))

    def run(batches):
        scorer, model = shared.value
        for batch in batches:
            x = np.array([scorer.features(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x))], names=[*batch.schema.names[:-1], score_col])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(score_col, T.DoubleType())])
    return rows.mapInArrow(run, schema)
