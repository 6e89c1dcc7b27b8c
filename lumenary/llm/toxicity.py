"""Toxicity: a learned lexicon's trie met by Levenshtein automata, and the context of each hit."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.llm.arrow import add_columns, texts
from lumenary.llm.storage import durable

#: Labelled rows that the model is fitted on at most, least toxic texts with a term and how many
#: times likelier it must be in them.
SAMPLE_ROWS, MIN_TEXTS, MIN_LIFT = 40_000, 6, 20.0
#: Letters of a stem, edits allowed in words of so many letters or more, words of context on a side.
STEM, EDIT_LETTERS, CONTEXT = (4, 5, 6), 5, 4
#: Share of a hit's weight that is left where the context quotes or reports it.
QUOTED = 0.3
#: Words known to a worker, and automaton states, at most.
KNOWN_WORDS, STATES = 600_000, 100_000

#: Signs written for letters, words that report speech, and quotation marks (fixed values).
_FOLD = str.maketrans("0134578@$!", "oieastbasi")
_REPORT = frozenset("said says wrote called quote quoted quotes quoting word words term terms phrase definition means meaning dit écrit mot sagte schrieb wort dijo escribió palabra".split())
_OPEN, _CLOSE = tuple("\"'«“„‘‹("), tuple("\"'»”“’›)")
_EDGE = ".,;:!?\"'()[]{}«»“”„‘’‹›…*#&%|<>-_~`"
FEATURES = 4


class Lexicon:
    """Terms and stems as a trie, met by the automaton of all words within one edit of one.

    A state is a set of (trie node, edits spent), known by a number. Stepping with a letter follows the
    child of that letter for free, and any child (substitution), the node itself (insertion) or, before
    it, a skipped trie letter (deletion) for one edit. States and steps are made on demand and shared by
    all words, so most words die after two or three dictionary look-ups.
    """

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.term: dict[int, list[int]] = defaultdict(list)
        self.stem = [is_stem for _, is_stem in terms]
        self.edits = [1 if len(t) >= EDIT_LETTERS and not is_stem else 0 for t, is_stem in terms]
        for k, (t, _) in enumerate(terms):
            node = 0
            for c in t:
                if c not in self.child[node]:
                    self.child.append({})
                    self.child[node][c] = len(self.child) - 1
                node = self.child[node][c]
            self.term[node].append(k)
        self._reset()

    def _reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.state: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.value: list[float] = []
        self.final: list[bool] = []
        self.start = self._known(self._closed({0: 0}))

    @staticmethod
    def _least(found: dict[int, int], node: int, edits: int) -> None:
        if edits <= 1 and edits < found.get(node, 2):
            found[node] = edits

    def _closed(self, found: dict[int, int]) -> frozenset:
        for node in [n for n, e in found.items() if e == 0]:
            for child in self.child[node].values():
                self._least(found, child, 1)
        return frozenset(found.items())

    def _known(self, state: frozenset) -> int:
        """Number of a state, -1 for the empty one; what a word that ends there is worth, and whether it has a stem by then."""
        if not state:
            return -1
        if state not in self.number:
            self.number[state] = len(self.state)
            self.state.append(state)
            self.steps.append({})
            spent = [e for n, e in state for k in self.term.get(n, ()) if e <= self.edits[k] and not self.stem[k]]
            stem = any(e == 0 and self.stem[k] for n, e in state for k in self.term.get(n, ()))
            self.value.append(1.0 if stem else (1.0, 0.8)[min(spent)] if spent else 0.0)
            self.final.append(stem)
        return self.number[state]

    def _step(self, at: int, letter: str) -> int:
        found: dict[int, int] = {}
        for node, edits in self.state[at]:
            if edits == 0:
                for c, child in self.child[node].items():
                    self._least(found, child, 0 if c == letter else 1)
                self._least(found, node, 1)
            elif (child := self.child[node].get(letter)) is not None:
                self._least(found, child, edits)
        to = self.steps[at][letter] = self._known(self._closed(found))
        return to

    def match(self, word: str) -> float:
        """1 for a term or stem, 0.8 for a term with one edit, else 0."""
        if len(self.state) > STATES:
            self._reset()
        at, steps, final = self.start, self.steps, self.final
        for letter in word:
            to = steps[at].get(letter)
            at = self._step(at, letter) if to is None else to
            if at < 0:
                return 0.0
            if final[at]:
                return 1.0
        return self.value[at]


def folded(word: str) -> str:
    """A word without the signs around it, and with letters for the signs inside that stand for some."""
    word = word.strip(_EDGE)
    return word.translate(_FOLD) if any(c.isalpha() for c in word) and not word.isalpha() else word


class Features:
    """Features of texts: whether there is a hit, hits, near hits, and weight by context; remembers words."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.lexicon = Lexicon(terms)
        self.known: dict[str, float] = {}
        self.hot: dict[str, float] = {}

    def of(self, text: str) -> list[float]:
        words = text.lower().split()
        distinct = set(words)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            self.hot.clear()
            new = distinct
        for w in new:
            bare = w.strip(_EDGE)
            value = self.lexicon.match(bare) if bare else 0.0
            if not value and not bare.isalpha() and (plain := folded(bare)) != bare:
                value = self.lexicon.match(plain)
            self.known[w] = value
            if value:
                self.hot[w] = value
        if not self.hot or self.hot.keys().isdisjoint(distinct):
            return [0.0] * FEATURES
        hits = near = weight = 0.0
        for i, w in enumerate(words):
            value = self.hot.get(w)
            if value:
                own = value * (QUOTED if self._quoted(words, i) else 1.0)
                hits += value == 1.0
                near += value < 1.0
                weight += own
        return [1.0, math.log1p(hits), math.log1p(near), math.log1p(weight)]

    @staticmethod
    def _quoted(words: list[str], i: int) -> bool:
        """Quotation marks opened before and closed behind the word, or a report of it in its context."""
        before, after = words[max(0, i - CONTEXT) : i + 1], words[i : i + CONTEXT + 1]
        marks = any(w.startswith(_OPEN) for w in before) and any(w.rstrip(".,;:!?").endswith(_CLOSE) for w in after)
        return marks or any(w.strip(_EDGE) in _REPORT for w in (*before[:-1], *after[1:]))


def affixes(text: str) -> set[str]:
    """Words of a text (ending in a space), and their beginnings of STEM letters."""
    words = {w.strip(_EDGE) for w in text.lower().split()}
    words.discard("")
    return {f"{w} " for w in words} | {w[:n] for w in words for n in STEM if len(w) > n}


def _affix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"affix": pa.array(list(counts), pa.string()), "n_other": pa.array([c[0] for c in counts.values()], pa.int64()), "n_toxic": pa.array([c[1] for c in counts.values()], pa.int64())})
        counts.clear()
        return out

    for batch in batches:
        for text, toxic in zip(texts(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
            for a in affixes(text):
                counts[a][toxic] += 1
            if len(counts) > 500_000:
                yield rows()
    yield rows()


def choose_terms(candidates: list[str], found: list[list[int]]) -> list[tuple[str, bool]]:
    """Fewest terms that explain the toxic texts: again and again the one that most unexplained texts have.

    ``found`` has the numbers of the candidates in each toxic text. So words that merely keep
    company with a term, in copies of one text, are not learned once the term is.
    """
    left = Counter(k for ks in found for k in ks)
    holders: dict[int, list[int]] = defaultdict(list)
    for d, ks in enumerate(found):
        for k in ks:
            holders[k].append(d)
    open_texts, chosen = set(range(len(found))), []
    while left:
        # Of equals the longer one, a whole word before a stem: it says less about other words.
        best = max(left, key=lambda k: (left[k], len(candidates[k]), candidates[k]))
        if left[best] < MIN_TEXTS:
            break
        chosen.append(candidates[best])
        for d in holders[best]:
            if d in open_texts:
                open_texts.discard(d)
                left.subtract(found[d])
        del left[best]
    return [(a.rstrip(" "), not a.endswith(" ")) for a in chosen]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights, the intercept first, of a logistic regression by Newton's method; the rest is shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
    return w


def is_training(doc_id: Column, folds: int = 5) -> Column:
    """True for rows whose labels may be learned: crc32 of the id as text is no multiple of ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != 0, F.lit(False))


class Model:
    """Lexicon and weights; small, as the sample that they come from is bounded."""

    def __init__(self, terms: list[tuple[str, bool]], weights: np.ndarray) -> None:
        self.terms, self.weights = terms, weights


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``sample_rows`` labelled training rows, those with the least hash of their id.

    The sample's ids are so few that they are broadcast; its distinct texts are written once. Counts
    of words and stems by label are summed by Spark over the sample; what comes to the driver is
    bounded by the sample.
    """
    picked = (
        labels.where("toxic is not null and doc_id is not null")
        .where(is_training(F.col("doc_id"), folds))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    sample = durable(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.max("toxic").cast("int").alias("toxic")))
    n_other, n_toxic = (sample.where(F.col("toxic") == k).count() for k in (0, 1))
    if not n_other or not n_toxic:
        share = (n_toxic + 0.5) / (n_other + n_toxic + 1)
        return Model([], np.array([math.log(share / (1 - share)) if n_other + n_toxic else -5.0, *[0.0] * FEATURES]))
    counts = sample.mapInArrow(_affix_counts, "affix string, n_other long, n_toxic long").groupBy("affix").agg(F.sum("n_other").alias("n_other"), F.sum("n_toxic").alias("n_toxic"))
    lift = (F.col("n_toxic") + 0.5) / n_toxic / ((F.col("n_other") + 0.5) / n_other)
    candidates = [r.affix for r in counts.where((F.col("n_toxic") >= MIN_TEXTS) & (lift >= MIN_LIFT)).orderBy(F.desc("n_toxic"), "affix").collect()]
    number = {a: k for k, a in enumerate(candidates)}

    def make(column: pa.Array) -> list:
        return [[sorted(number[a] for a in affixes(t) & number.keys()) for t in texts(column)]]

    found = [r.found for r in add_columns(sample.where("toxic = 1"), "text", [T.StructField("found", T.ArrayType(T.IntegerType()))], make).select("found").collect()]
    terms = choose_terms(candidates, found)
    rows = _with_features(sample, terms).select("toxic", "features").collect()
    x = np.array([r.features for r in rows], float).reshape(len(rows), FEATURES)
    return Model(terms, fit_logistic(x, np.array([r.toxic for r in rows], float)))


def _with_features(docs: DataFrame, terms: list[tuple[str, bool]]) -> DataFrame:
    ready: list[Features] = []

    def make(column: pa.Array) -> list:
        if not ready:
            ready.append(Features(terms))
        return [[ready[0].of(t) for t in texts(column)]]

    return add_columns(docs, "text", [T.StructField("features", T.ArrayType(T.DoubleType()))], make)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``, by its text alone.

    The score is the probability of label 1. A null or empty text has no hits and gets the score of
    a text without any. A row with a null id is held out. Without labels of both kinds every text
    has the same score. Other columns are not read; repeated rows agree.
    """
    model = fit(docs, labels, folds)
    own = docs.select("doc_id", "text").withColumn("held_out", ~is_training(F.col("doc_id"), folds))
    logit = F.lit(float(model.weights[0]))
    for k in range(FEATURES):
        logit = logit + F.col("features")[k] * float(model.weights[k + 1])
    score = 1 / (1 + F.exp(-logit))
    return _with_features(own, model.terms).select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
