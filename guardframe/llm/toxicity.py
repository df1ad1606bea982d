"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over hashed words and word beginnings that a document
holds. For each labelled sentence that mentions a group, twins are made in
which the identity terms are swapped for others of their set; the training
penalises the squared change of the raw score between sentence and twin. So
that terms count which no labelled sentence holds, or which hold together in
all of them, a sentence with and without each term is such a pair as well. A
neutral mention of any group then moves no score. Twins are made for training
only, of every sentence of the sampled documents; scores are of the texts as
they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Set
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardframe.llm.common import materialise, released, slices
from guardframe.llm.labelled import hashed, letters_of, sample, sparse

BUCKETS = 1 << 20
#: Letters of the longest beginning that is a feature.
LONGEST = 7
#: Substitutions for each sentence with identity terms.
TWINS = 3
#: Units of a one in sums of shares, which are whole numbers so that no order matters.
UNIT = 1 << 40
#: Identity terms, by set; within a set any may stand for another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous", "hispanic"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("american", "mexican", "chinese", "russian", "indian", "german", "french", "spanish", "turkish", "polish"),
    ("blind", "deaf", "disabled", "autistic", "elderly", "young"),
    ("immigrant", "refugee", "foreigner", "citizen", "native"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas"),
)


def word_features(word: str, buckets: int = BUCKETS) -> list[int]:
    """A word of small letters: itself, and its beginnings of three letters or more."""
    return [hashed(f"{word}$", buckets), *(hashed(f"^{word[:k]}", buckets) for k in range(3, min(LONGEST, len(word)) + 1))]


_SENTENCE = re.compile(r"[^.!?\n]+")
_TERMS = {w: (terms, i) for terms in IDENTITY_TERMS for i, w in enumerate(terms)}


def swapped(words: Set[str], turn: int) -> set[str] | None:
    """The words with each identity term replaced by another of its set; None if there is none."""
    if words.isdisjoint(_TERMS):
        return None
    step = lambda terms, i: terms[(i + 1 + turn % (len(terms) - 1)) % len(terms)]
    return {step(*_TERMS[w]) if w in _TERMS else w for w in words}


def document_features(words: Iterable[str]) -> np.ndarray:
    return np.unique(np.array([f for w in words for f in word_features(w)], dtype=np.uint32))


def document_words(text: str | None) -> set[str]:
    return {w for token in set((text or "").split()) for w in letters_of(token)}


_TERM_FEATURES = frozenset(document_features(_TERMS).tolist())
Pair = tuple[np.ndarray, np.ndarray]


@lru_cache(1 << 16)
def _shared(word: str) -> tuple[int, ...]:
    """The word's features that an identity term has as well."""
    return tuple(f for f in word_features(word) if f in _TERM_FEATURES)


Mention = tuple[frozenset[str], frozenset[int]]


def _mentions(text: str | None) -> Iterator[Mention]:
    """For each sentence with identity terms: these, and the features of such terms that its other words have."""
    for sentence in _SENTENCE.finditer(text or ""):
        words = document_words(sentence.group())
        if named := words & _TERMS.keys():
            yield frozenset(named), frozenset(f for w in words - named for f in _shared(w))


@lru_cache(1 << 12)
def _twins(mention: Mention, twins: int = TWINS) -> tuple[Pair, ...]:
    named, rest = mention
    own, others = set(document_features(named)), dict.fromkeys(tuple(sorted(swapped(named, turn))) for turn in range(twins))
    pair = lambda twin: (twin - own - rest, own - twin - rest)
    return tuple(tuple(np.array(sorted(x), dtype=np.uint32) for x in pair(set(document_features(o)))) for o in others)


def sentence_pairs(text: str | None, twins: int = TWINS) -> list[Pair]:
    """For each sentence with identity terms and each substitution: the features that the twin
    has beyond the sentence, and those that it lacks."""
    return [pair for mention in _mentions(text) for pair in _twins(mention, twins)]


def _counted(text: str | None) -> Iterator[tuple[Pair, int]]:
    """The pairs of ``sentence_pairs`` and how often each occurs, from a bounded number of sentences at a time."""
    for some in batched(_mentions(text), 10_000):
        for mention, times in Counter(some).items():
            yield from ((pair, times) for pair in _twins(mention))


def mention_pairs() -> list[Pair]:
    """A sentence with and without each identity term: what the term adds."""
    return [(document_features({w}), np.zeros(0, dtype=np.uint32)) for terms in IDENTITY_TERMS for w in terms]


def touched(keep: np.ndarray) -> np.ndarray:
    """Those of the features ``keep`` that an identity term has, ascending: no others differ in a pair."""
    return np.intersect1d(keep, document_features(_TERMS))


def moved(counted: Iterable[tuple[Pair, int]], features: np.ndarray) -> np.ndarray | None:
    """The mean, over pairs (each with its number) that differ in any of the features, of the
    products of each two features' changes (1, -1 or 0); None without such pairs.

    The mean squared change of a score is this matrix between the weights, so
    that it stands for any number of pairs.
    """
    out, n = np.zeros((features.size, features.size), dtype=np.int64), 0
    for pair, times in counted:
        at, sign = [], []
        for some, way in zip(pair, (1, -1), strict=True):
            found = np.flatnonzero(np.isin(features, some))
            at.append(found)
            sign.append(np.full(found.size, way))
        place, change = np.concatenate(at), np.concatenate(sign)
        if place.size:
            out[np.ix_(place, place)] += np.outer(change, change) * times
            n += times
    return out / n if n else None


class Weights:
    """Sparse weights (feature id -> weight) and an intercept."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, intercept: float):
        self.features, self.weights, self.intercept = features, weights, intercept


def train(keep: np.ndarray, rows: list[np.ndarray], y: np.ndarray, changes: np.ndarray, shift: float, steps: int = 150, l2: float = 2e-4, penalty: float = 1.0) -> Weights:
    """Full-batch gradient steps with per-weight step sizes, over the features in ``keep`` (ascending).

    ``changes`` is the mean matrix of ``moved`` over ``touched(keep)``; ``penalty``
    weighs the mean squared change of the raw score that it gives.
    """
    if len(set(y.tolist())) < 2:
        return Weights(np.zeros(0, np.uint32), np.zeros(0), 10.0 if len(y) and y[0] else -10.0)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    place = lambda r: 1 + np.searchsorted(keep, r[np.isin(r, keep)])  # noqa: E731  0 is the intercept
    index, starts = sparse([np.append(0, place(r)) for r in rows])
    which = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, index.size)))
    between = place(touched(keep))
    balance = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, seen = np.zeros(keep.size + 1), np.zeros(keep.size + 1)
    for _ in range(steps):
        z = np.add.reduceat(w[index], starts)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        g = np.bincount(index, weights=d[which], minlength=w.size) + l2 * np.append(0, w[1:]) / w.size
        g[between] += 2 * penalty * (changes @ w[between])
        seen += g * g
        w -= 0.5 * g / (np.sqrt(seen) + 1e-8)
    # The steps weigh both classes alike; half of the true log odds is given back, which
    # keeps a text with a single clear sign above one half.
    return Weights(keep.astype(np.uint32), w[1:], float(w[0] + 0.5 * (np.log(n1 / n0) - shift)))


def telling(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """Of (``feature``, ``pos``, ``neg``) the features that at least four sampled documents hold, one class far more often."""
    odds = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
    return counts.where((F.col("pos") + F.col("neg") >= 4) & (F.abs(odds) > 3 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", penalty: float = 1.0) -> Weights:
    """Fit on the bounded labelled sample.

    Features are made, counted and selected on the executors; the driver gets
    the selected ones and what the sampled documents hold of them. Of the twins
    it gets the matrix of ``moved``, of all sentences: each document with pairs
    counts as one, however long it is, and so does each identity term's mention.
    """
    rows, n, shift = sample(docs, labels, label)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("own", T.BinaryType())])
    array = lambda b: np.frombuffer(b, dtype=np.uint32)

    def batch_of(keys: pa.Array, y: pa.Array, own: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, y, pa.array([x.tobytes() for x in own], pa.binary())], names=schema.names)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch_of(batch.column("key"), batch.column("y"), [document_features(document_words(t)) for t in batch.column("text").to_pylist()])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for y, own in zip(batch.column("y").to_pylist(), batch.column("own").to_pylist(), strict=True):
                both[y][array(own)] += 1
        some = np.flatnonzero(both.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[1][some]), pa.array(both[0][some])], names=["feature", "pos", "neg"])

    made = materialise(rows.select("key", "y", "text").mapInArrow(released(features), schema), "features")
    partial = made.select("y", "own").mapInArrow(released(counts), "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    keep = np.sort(telling(partial, n.get(1, 0), n.get(0, 0)).select("feature").toArrow().column(0).to_numpy()).astype(np.uint32)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(batch.column("key"), batch.column("y"), [np.intersect1d(array(b), keep, assume_unique=True) for b in batch.column("own").to_pylist()])

    between = touched(keep)

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents = np.zeros((between.size, between.size), dtype=np.int64), 0
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                own = moved(_counted(text), between)
                if own is not None:
                    total += np.rint(own * UNIT).astype(np.int64)
                    documents += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total.ravel()[at], documents))], names=["place", "sum"])

    changes, several = np.zeros((between.size, between.size)), 0
    if between.size:
        mentions = [moved([(p, 1)], between) for p in mention_pairs()]
        for own in mentions:
            if own is not None:
                changes += own
                several += 1
        sums = rows.select("text").mapInArrow(released(changed), "place long, sum long").groupBy("place").agg(F.sum("sum").alias("sum")).toArrow()
        place, value = (sums.column(c).to_numpy() for c in ("place", "sum"))
        several += int(value[place < 0].sum())
        changes.ravel()[place[place >= 0]] += value[place >= 0] / UNIT
        changes /= max(1, several)
    found = sorted(made.mapInArrow(released(kept), schema).collect(), key=lambda r: r["key"])
    return train(keep, [array(bytes(r["own"])) for r in found], np.array([r["y"] for r in found], dtype=np.int64), changes, shift, penalty=penalty)


class Scorer:
    """Scores texts; what a token adds is looked up once in a bounded cache."""

    def __init__(self, model: Weights, most: int = 300_000):
        self.weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
        self.intercept, self.most, self.tokens, self.beginnings = model.intercept, most, {}, {}

    def _beginning(self, letters: str) -> tuple[int, ...]:
        found = tuple(f for f in word_features(letters)[1:] if f in self.weight)
        if len(self.beginnings) >= self.most:
            self.beginnings.clear()
        self.beginnings[letters] = found
        return found

    def _token(self, token: str) -> tuple[int, ...]:
        found: tuple[int, ...] = ()
        for word in letters_of(token):
            letters = word[:LONGEST]
            some = self.beginnings.get(letters)
            found += self._beginning(letters) if some is None else some
            if (whole := hashed(f"{word}$", BUCKETS)) in self.weight:
                found += (whole,)
        if len(self.tokens) >= self.most:
            self.tokens.clear()
        self.tokens[token] = found
        return found

    def score(self, text: str | None) -> float:
        known, features = self.tokens, set()
        for token in set((text or "").split()):
            found = known.get(token)
            if found is None:
                found = self._token(token)
            if found:
                features.update(found)
        z = self.intercept + sum(self.weight[f] for f in sorted(features))
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def score(docs: DataFrame, model: Weights, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` double, 0 to 1, higher for label 1.

    Narrow: no shuffle; the model is of fixed size. A null or empty text gets the
    intercept's score; repeated rows each give a row; other columns pass through,
    but for one called ``score``, which is replaced. Without labelled rows of both
    classes every score is next to 0, or to 1 if the only class is 1.
    """
    kept = docs.drop("score")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, text):
            found = [scorer.score(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(released(run), schema)
