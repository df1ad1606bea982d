"""Text quality by supervised subword embeddings.

Every token gives hashed features: itself, its byte trigrams, and, where it or
its line has occurred in the text before, an n-gram of the order in which it
recurs (doublings of the number of times, or right after itself). Each bucket has a learned vector; a
document is the mean of its features' vectors, and a softmax layer on top gives
the class. Vectors and layer are trained together by stochastic gradient
descent in numpy.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardframe.llm.common import released, slices
from guardframe.llm.labelled import sample

BUCKETS, WIDTH = 1 << 17, 12
#: Labelled documents taken of each class at most.
SAMPLE = 1500
#: Doublings of the number of times up to which recurrences differ.
RECURS = 16


def token_features(token: str) -> list[int]:
    data, crc = f"<{token}>".encode("utf-8", "surrogatepass"), zlib.crc32
    return [crc(data) % BUCKETS, *(crc(data[i : i + 3]) % BUCKETS for i in range(len(data) - 2))]


@cache
def recurrence_features() -> dict[str, list[int]]:
    """Buckets of what recurs: for tokens and lines, by doublings of the number of times."""
    return {kind: [zlib.crc32(f"{kind} {k}".encode()) % BUCKETS for k in range(RECURS)] for kind in ("token", "line", "twice")}


def recurrences(times: Iterable[int]) -> list[int]:
    """How many occurrences are the second, the third or fourth, the fifth to eighth, and so on,
    given how often each thing occurs."""
    out: list[int] = []
    spread = Counter(times)
    spread.pop(1, None)
    for n, things in spread.items():
        k = 0
        while n > 1 << k and k < RECURS:
            if k == len(out):
                out.append(0)
            last = n if k == RECURS - 1 else min(n, 2 << k)
            out[k] += (last - (1 << k)) * things
            k += 1
    return out


def repeats(text: str, tokens: list[str], times: Counter[str]) -> list[tuple[int, int]]:
    """Features of what recurs in a text, and how often each occurs."""
    lines = Counter([x for x in text.split("\n") if x and not x.isspace()])
    own = recurrence_features()
    return [*zip(own["token"], recurrences(times.values())), *zip(own["line"], recurrences(lines.values())), (own["twice"][0], sum(map(eq, tokens, islice(tokens, 1, None))))]  # noqa: B905


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text, and the share of each."""
    tokens = (text or "").split()
    times, many = Counter(tokens), Counter[int]()
    for token, n in times.items():
        for f in token_features(token):
            many[f] += n
    for f, n in repeats(text or "", tokens, times):
        many[f] += n
    ids = np.array(sorted(f for f, n in many.items() if n), dtype=np.uint32)
    shares = np.array([many[f] for f in ids.tolist()], dtype=np.float32)
    return ids, shares / max(1.0, float(shares.sum()))


class Model:
    """What scoring needs: each feature's part of the raw score, and the intercept."""

    def __init__(self, parts: np.ndarray, intercept: float):
        self.parts, self.intercept = parts.astype(np.float32), intercept


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, shift: float, epochs: int = 12, rate: float = 4.0, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document at a time, with a falling rate."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 10.0 if len(y) and y[0] else -10.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    target = np.eye(2, dtype=np.float32)[y]
    done, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, shares = rows[i]
            step = rate * (1 - done / total)
            done += 1
            hidden = shares @ vectors[ids]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            d = p / p.sum() - target[i]
            back = layer @ d
            layer -= step * np.outer(hidden, d)
            bias -= 0.1 * step * d
            vectors[ids] -= (step * shares)[:, None] * back
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]) - shift)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on the bounded labelled sample; features are made on the executors."""
    rows, _, shift = sample(docs, labels, label, SAMPLE)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("shares", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [document_features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1))], names=schema.names)

    found = sorted(rows.select("key", "y", "text").mapInArrow(released(run), schema).collect(), key=lambda r: r["key"])
    return train([(np.frombuffer(bytes(r["ids"]), dtype=np.uint32), np.frombuffer(bytes(r["shares"]), dtype=np.float32)) for r in found], np.array([r["y"] for r in found], dtype=np.int64), shift)


class Scorer:
    """Scores texts; what a token adds is looked up once in a bounded cache."""

    def __init__(self, model: Model, most: int = 300_000):
        self.parts, self.intercept, self.most = model.parts.tolist(), model.intercept, most
        self.tokens: dict[str, complex] = {}

    def _token(self, token: str) -> complex:
        """Sum of the token's parts, and (imaginary) how many features it has."""
        features = token_features(token)
        parts = self.parts
        found = complex(sum([parts[f] for f in features]), len(features))
        if len(self.tokens) >= self.most:
            self.tokens.clear()
        if len(token) < 100:
            self.tokens[token] = found
        return found

    def score(self, text: str | None) -> float:
        tokens = (text or "").split()
        times = Counter(tokens)
        known, one, parts = self.tokens, self._token, self.parts
        both = sum([(known.get(t) or one(t)) * n for t, n in times.items()], 0j)
        for f, n in repeats(text or "", tokens, times):
            both += complex(parts[f], 1) * n
        z = self.intercept + both.real / max(1.0, both.imag)
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
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
