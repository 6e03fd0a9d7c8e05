"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

A sentence is read as its words; letters that stand alone one after another are one word, so an insult that was spaced out is whole again. The
kernel of two words counts the subsequences of three to five characters that they share, a gap of one character costing a factor and spans
being bounded, so inserted or missing characters weaken a match but do not undo it. Landmark words give each word a
vector, and the machine is linear in it. Such a score is linear in the subsequences too: the landmarks' weights are added up
in one table by hashed subsequence, and scoring a word looks its subsequences up. That equals the sum over landmarks and does not depend on
their number.

Labels belong to whole texts, so the machine learns by turns: words of clean texts are negative; of a toxic text first the words that are typical of toxic texts
are positive, then those that score best in it. A text's score is a logistic regression on its best three words and its length, fitted on
scores by machines that have not seen the text.

Training reads a bounded sample of labelled texts on the driver. Scoring is one pass without a shuffle.

Defined cases: a null or empty text has no words and gets the score that the regression gives to that; texts are scored whole; long words are scored in overlapping parts;
repeated rows are scored each; without labels of both classes every score is the smoothed share of toxic labels; a text with several labels
is toxic if one says so; null labels are left out; an empty table gives an empty table; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.llm.common import map_batches, texts_of

# Labelled texts of each class used at most, and characters that such a text may have.
MOST_LABELLED, MOST_CHARACTERS = 3000, 20000
# Kernel: subsequences of each length with the span they may have, the factor of a gap, hash bins of subsequences.
SPANS = {3: 5, 4: 6, 5: 7}
GAP = 0.5
BINS = 1 << 20
LANDMARKS, TYPICAL, FREQUENT = 360, 200, 100
# Clean words, hardest clean words and typical words that training uses at most, and the total cost of errors of each class.
CLEAN, HARD, MOST_TYPICAL, COST = 6000, 2000, 600, 400.0
LONGEST, STEP = 24, 12
_REMEMBERED = 300_000
_EDGE = ".,;:!?\"'()[]{}<>#$%&*+-/=@^_`|~…«»¿¡„“”’‘"
_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_SIGNS = re.compile(r"[\W_]+")
_LOW, _HIGH = -2.0, 3.0


def words_of(text: str) -> list[str]:
    """Words in lower case without outer punctuation; spaced-out letters are joined, long words cut into overlapping parts."""
    text = text.lower()
    found = [w.strip(_EDGE) for w in text.split()]
    # A word with signs inside is also read without them.
    found += [_SIGNS.sub("", w) for w in found if not w.isalnum() and _SIGNS.search(w)]
    # Three neighbours of one character each are rare; only then is the text searched for them.
    if any(len(a) == 1 and len(b) == 1 and len(c) == 1 for a, b, c in zip(found, found[1:], found[2:], strict=False)):
        found += ["".join(m[0].split()) for m in _SPACED.finditer(text)]
    return [p for w in found if w for p in ([w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - STEP, STEP)])]


def _patterns() -> list[tuple[tuple[int, ...], float]]:
    """Places of a subsequence's characters after its first one, with the weight of its gaps."""
    out = []
    for size, span in SPANS.items():
        for rest in combinations(range(1, span), size - 1):
            out.append(((0, *rest), GAP ** (rest[-1] + 1 - size)))
    return out


_PATTERNS = _patterns()


def _codes(words: list[str]) -> np.ndarray:
    """Characters of words of one length, between marks of their beginning and end."""
    n = len(words[0])
    table = np.empty((len(words), n + 2), np.uint32)
    table[:, 0], table[:, -1] = 1, 2
    table[:, 1:-1] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
    return table


def by_length(words: list[str], most: int = 4096):
    """Places of words of one length, at most so many at once."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for lo in range(0, len(at), most):
            yield at[lo : lo + most]


def _hashed(codes: np.ndarray, places: tuple[int, ...], made: dict[tuple[int, ...], np.ndarray]) -> np.ndarray:
    """Hashes of the subsequences at some places; ``made`` keeps those of their beginnings. Not a closure that calls itself: such a cycle
    would hold the arrays until the garbage collector runs."""
    many = codes.shape[1] - places[-1]
    if places not in made:
        before = _hashed(codes, places[:-1], made)[:, :many] if len(places) > 1 else np.uint32(0x85EBCA6B)
        h = (before ^ codes[:, places[-1] : places[-1] + many]) * np.uint32(0x9E3779B1)
        made[places] = h ^ (h >> np.uint32(15))
    return made[places][:, :many]


def subsequences(words: list[str]):
    """(bins, weight) of each pattern for words of one length; bins is a table of words by places."""
    codes = _codes(words)
    n = codes.shape[1]
    made: dict[tuple[int, ...], np.ndarray] = {}
    for places, weight in _PATTERNS:
        if n > places[-1]:
            yield (_hashed(codes, places, made) + np.uint32(len(places) * 0x1F123BB5)) % np.uint32(BINS), weight


def _norm(length: int) -> float:
    """Scale of a word: the root of the summed squares of its subsequences' weights, which depends on its length only."""
    return float(np.sqrt(sum(w * w * max(0, length + 2 - p[-1]) for p, w in _PATTERNS))) or 1.0


def _bins_of(words: list[str]):
    """(word, bin, weight) of all subsequences, in arrays, a group of words at a time; weights are scaled."""
    for at in by_length(words):
        part = [words[i] for i in at]
        norm = _norm(len(part[0]))
        for bins, weight in subsequences(part):
            yield np.repeat(at, bins.shape[1]), bins.ravel().astype(np.int64), weight / norm


class _Landmarks:
    """Landmark words with their scaled subsequences, as the landmarks and weights of each bin that occurs; few landmarks share a bin."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        found = list(_bins_of(words))
        bins = np.concatenate([b for _, b, _ in found])
        owner = np.concatenate([i for i, _, _ in found])
        weights = np.concatenate([np.full(len(b), w, np.float32) for _, b, w in found])
        order = np.argsort(bins, kind="stable")
        self.used, self.first, self.many = np.unique(bins[order], return_index=True, return_counts=True)
        self.owner, self.weights = owner[order], weights[order]

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernel of words with the landmarks."""
        wide = len(self.words)
        out = np.zeros((len(words), wide), np.float32)
        for at in by_length(words, 256):
            part = [words[i] for i in at]
            total = np.zeros(len(part) * wide)
            for bins, weight in subsequences(part):
                flat = bins.ravel().astype(np.int64)
                place = np.minimum(np.searchsorted(self.used, flat), len(self.used) - 1)
                hit = np.flatnonzero(self.used[place] == flat)
                place, row = place[hit], hit // bins.shape[1]
                many = self.many[place]
                # One entry for each landmark of each bin that is hit.
                entry = np.arange(many.sum()) + np.repeat(self.first[place] - np.cumsum(many) + many, many)
                np.add.at(total, np.repeat(row, many) * wide + self.owner[entry], weight * self.weights[entry])
            out[at] = total.reshape(len(part), wide) / _norm(len(part[0]))
        return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of words with landmarks."""
    return _Landmarks(landmarks).kernel(words)


class Model(NamedTuple):
    """Weights by subsequence bin and intercept of a word's score; coefficients of a text's score."""

    table: np.ndarray
    intercept: float
    text: np.ndarray


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Scores of words, in groups of similar length."""
    out = np.zeros(len(words))
    for at in by_length(words):
        part = [words[i] for i in at]
        total = np.zeros(len(part))
        for bins, weight in subsequences(part):
            total += weight * model.table[bins].sum(1)
        out[at] = total / _norm(len(part[0]))
    return np.clip(out + model.intercept, _LOW, _HIGH)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the examples inside the margin."""
    w = np.zeros(x.shape[1] + 1)
    penalty = np.diag(np.append(np.full(x.shape[1], ridge), 1e-6))
    for _ in range(steps):
        inside = np.flatnonzero(y * (x @ w[:-1] + w[-1]) < 1)
        left, right = penalty.copy(), np.zeros(len(w))
        for lo in range(0, len(inside), 1000):
            at = inside[lo : lo + 1000]
            a = np.hstack([x[at], np.ones((len(at), 1))])
            left += (a * cost[at, None]).T @ a
            right += a.T @ (cost[at] * y[at])
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.001, steps: int = 4000) -> np.ndarray:
    """Coefficients and, last, the intercept. Higher word scores never lower a text's score."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = np.full(len(y), 1 / len(y))
    rate = 1.0 / (0.25 * (weight[:, None] * x1 * x1).sum() + ridge)
    w = ahead = np.zeros(x1.shape[1])
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ ahead, -30, 30)))
        new = ahead - rate * (x1.T @ (weight * (p - y)) + ridge * ahead)
        new[:3] = np.maximum(new[:3], 0)
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


def text_features(scores: np.ndarray) -> np.ndarray:
    """The best three word scores, least first, and the length; a missing word has the lowest score."""
    best = np.sort(np.concatenate([np.full(3, _LOW), scores if len(scores) <= 3 else np.partition(scores, len(scores) - 3)[-3:]]))[-3:]
    return np.append(best, np.log1p(len(scores)) / 5)


def text_score(model: Model, features: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(features @ model.text[:-1] + model.text[-1], -30, 30))))


class _Machine:
    """Landmarks and the vectors of the words met so far."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        self.table = _Landmarks(landmarks)
        values, vectors = np.linalg.eigh(self.table.kernel(landmarks).astype(np.float64))
        self.root = vectors[:, values > 1e-4] / np.sqrt(values[values > 1e-4])
        self.known: dict[str, np.ndarray] = {}

    def vectors(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, (self.table.kernel(new) @ self.root).astype(np.float32), strict=True))
        return np.stack([self.known[w] for w in words])

    def model(self, positive: list[str], counts: np.ndarray, clean: list[str], hard: Counter[str]) -> Model:
        """Fit typical words against clean ones; ``hard`` are clean words that an earlier fit took for toxic ones. Words count by the texts that hold them."""
        x = np.vstack([self.vectors(positive), self.vectors(clean), *([self.vectors(list(hard))] if hard else [])])
        target = np.r_[np.ones(len(positive)), -np.ones(len(clean) + len(hard))]
        cost = np.r_[counts / counts.sum(), np.full(len(clean), 1 / len(clean)), np.array(list(hard.values()), float) / max(hard.total(), 1)] * COST
        beta, intercept = _svm(x, target, cost)
        alpha, table = self.root @ beta, np.zeros(BINS)
        for i, bins, weight in _bins_of(self.landmarks):
            np.add.at(table, bins, weight * alpha[i])
        return Model(table.astype(np.float32), intercept, np.zeros(5))


class _Texts(NamedTuple):
    """Labelled texts as numbers of words: each text's words in order of their numbers, without repeats, and the words themselves in order."""

    vocabulary: list[str]
    sets: list[np.ndarray]
    toxic: np.ndarray

    def holders(self, texts: np.ndarray) -> np.ndarray:
        """How many of the given texts hold each word."""
        found = [self.sets[i] for i in texts]
        return np.bincount(np.concatenate(found) if found else np.empty(0, np.int64), minlength=len(self.vocabulary))


def _typical(texts: _Texts, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that are typical of toxic texts, most typical first, and the numbers of toxic and clean texts that hold each word."""
    toxic = texts.toxic[seen]
    in_pos, in_neg = texts.holders(seen[toxic]), texts.holders(seen[~toxic])
    odds = np.log((in_pos + 0.1) / (in_neg + 0.1) * ((~toxic).sum() + 1) / (toxic.sum() + 1))
    long = np.array([len(w) >= 3 for w in texts.vocabulary], bool)
    order = np.argsort(-odds * in_pos, kind="stable")
    return order[((in_pos > 1) & long & (odds > 2))[order]], in_pos, in_neg


def _fit_words(machine: _Machine, texts: _Texts, seen: np.ndarray, clean: np.ndarray, rounds: int = 2) -> Model:
    """The machine of the seen texts."""
    named = texts.vocabulary
    typical, in_pos, in_neg = _typical(texts, seen)
    negatives = [named[i] for i in clean if in_neg[i]] or [named[i] for i in clean]
    base = typical[:MOST_TYPICAL] if len(typical) else np.argsort(in_neg - in_pos, kind="stable")[:50]
    counts = np.zeros(len(named))
    counts[base] = in_pos[base]
    hard: Counter[str] = Counter()
    for k in range(rounds + 1):
        positive = np.flatnonzero(counts)
        model = machine.model([named[i] for i in positive], counts[positive], negatives, hard)
        if k == rounds:
            break
        score = word_scores(model, named)
        others = np.flatnonzero(in_neg)
        if len(others):
            worst = others[np.argsort(-score[others], kind="stable")[:HARD]]
            hard |= Counter({named[i]: int(in_neg[i]) for i in worst})
        least = max(0.0, np.quantile(score[others], 0.999)) if len(others) else 0.0
        counts = np.zeros(len(named))
        for i in seen[texts.toxic[seen]]:
            own = texts.sets[i][in_neg[texts.sets[i]] == 0]
            best = own[np.argsort(-score[own], kind="stable")[:4]]
            counts[best[score[best] > least]] += 1
        counts[base] = np.maximum(counts[base], in_pos[base])
    return model


def train(texts: list[str], toxic: list[bool], folds: int = 3) -> Model:
    """Fit the machine on all texts, and the regression on scores of texts by machines that have not seen them."""
    y = np.array(toxic, dtype=bool)
    if y.sum() < folds or (~y).sum() < folds:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(BINS, np.float32), 0.0, np.array([0, 0, 0, 0, np.log(share / (1 - share))]))
    rng = np.random.default_rng(5)
    fold = np.zeros(len(y), int)
    for value in (True, False):
        at = rng.permutation(np.flatnonzero(y == value))
        fold[at] = np.arange(len(at)) % folds
    number: dict[str, int] = {}
    tokens = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    vocabulary = sorted(number)
    place = np.zeros(len(number), np.int32)
    place[[number[w] for w in vocabulary]] = np.arange(len(vocabulary))
    tokens = [place[t] for t in tokens]
    known = _Texts(vocabulary, [np.unique(t) for t in tokens], y)
    everything = np.arange(len(y))
    typical, _, in_neg = _typical(known, everything)
    mixed = np.argsort([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in vocabulary], kind="stable")
    clean = mixed[in_neg[mixed] > 0][:CLEAN]
    frequent = np.argsort(-in_neg, kind="stable")[:FREQUENT]
    machine = _Machine([vocabulary[i] for i in dict.fromkeys([*typical[:TYPICAL], *frequent, *clean])][:LANDMARKS])
    features = np.zeros((len(y), 4))
    for k in range(folds):
        score = word_scores(_fit_words(machine, known, np.flatnonzero(fold != k), clean), vocabulary)
        for i in np.flatnonzero(fold == k):
            features[i] = text_features(score[tokens[i]])
    final = _fit_words(machine, known, everything, clean)
    return final._replace(text=_logistic(features, y.astype(float)))


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, longest: int = MOST_CHARACTERS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[bool]]:
    """At most ``most`` labelled texts of each class, those of least hash of the id among those of at most ``longest`` characters; of several
    texts with one id the one of least hash."""
    known = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull()).groupBy(labels[id_col].alias("__id")).agg((F.max(label_col) > 0).alias("__toxic"))
    texts = docs.select(docs[id_col].alias("__doc"), docs[text_col].alias("__text")).where(F.char_length("__text") <= longest).withColumn("__hash", F.xxhash64("__text"))
    # One row for each id, without its text, before the limit.
    once = texts.groupBy("__doc").agg(F.min("__hash").alias("__least"))
    usable = known.join(once, known["__id"] == once["__doc"]).select("__id", "__toxic", "__least")
    picked = [usable.where(side).orderBy(F.xxhash64("__id"), "__id").limit(most) for side in (F.col("__toxic"), ~F.col("__toxic"))]
    # Two times ``most`` ids at most.
    ids = F.broadcast(picked[0].union(picked[1]))
    found = texts.join(ids, (texts["__doc"] == ids["__id"]) & (texts["__hash"] == ids["__least"]))
    got = found.select("__id", "__text", "__toxic").dropDuplicates(["__id"]).collect()
    got.sort(key=lambda r: (r[0], r[1]))
    return [r[1] for r in got], [bool(r[2]) for r in got]


class _Scores(dict):
    """Scores of the words met so far, up to a bound."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self))
        if new:
            if len(self) > _REMEMBERED:
                self.clear()
                new = list(words)
            self.update(zip(new, word_scores(self.model, new).tolist(), strict=True))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every text. The model is broadcast; its size is fixed by ``BINS``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def process():
        known = _Scores(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, texts = [], texts_of(batch)
            for lo in range(0, len(texts), 250):
                words = [words_of(t) for t in texts[lo : lo + 250]]
                known.learn(set().union(*words))
                for w in words:
                    found.append(text_score(known.model, text_features(np.fromiter(map(known.__getitem__, w), float, len(w)))))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

        return step

    return map_batches(rows, f"doc_id {kind}, score double", process)
