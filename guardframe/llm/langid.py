"""Language identification by rank-order profiles.

A document's most frequent letter n-grams (one to three letters, word edges
counted as a letter) are ranked and compared with each language's ranked
profile: the sum of how far each n-gram is out of place, where an n-gram the
profile hasn't costs the whole profile's length.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardframe.llm.common import fold, released, slices

#: Length of a profile, and of a document's list.
PROFILE = 400
#: What stands for a word's edge, which is no letter's code.
EDGE = 1
#: What is predicted for a text without letters.
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point the code point of its small letter, EDGE for what isn't a letter."""
    out = np.full(sys.maxunicode + 1, EDGE, dtype=np.uint64)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            small = c.lower()
            out[i] = ord(small) if len(small) == 1 else i
    return out


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as packed 21-bit letters, ascending, and their counts.

    Runs of what isn't a letter are one edge. No letter has the code 0, so n-grams
    of different lengths differ.
    """
    code = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _letters()[code]
    inside = letters != EDGE
    kept = inside | np.append(True, inside[:-1])  # one edge between words
    letters, inside = letters[kept], inside[kept]
    one = letters[inside]
    if not one.size:
        return one, np.zeros(0, dtype=np.int64)
    two = (letters[:-1] << np.uint64(21)) | letters[1:]
    three = ((letters[:-2] << np.uint64(42)) | (two[1:]))[inside[1:-1]]
    keys = np.concatenate([one, two, three])
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.diff(np.append(first, keys.size))


def ranked(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    return keys[np.argsort(-counts, kind="stable")[:most]]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=keys.size).astype(np.int64)


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = PROFILE) -> dict[str, np.ndarray]:
    """The ranked profile of each non-null language over all of ``docs``.

    Counts are summed inside each task, then by (language, n-gram): a language
    with most of the rows only makes longer partial sums. The driver gets
    ``most`` rows for each language.
    """
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)
        for batch in slices(batches, "text"):
            for t, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found = ngram_counts(t)
                held[name].append(found)
                sizes[name] += found[0].size
                if sizes[name] > 1_000_000:
                    held[name] = [_merge(held[name])]
                    sizes[name] = min(held[name][0][0].size, 500_000)
        for name, parts in held.items():
            keys, counts = _merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * keys.size, pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], names=schema.names)

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(released(run), schema)
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    found: dict[str, list] = defaultdict(list)
    for row in top.orderBy("lang", "rank").collect():
        found[row["lang"]].append(row["gram"])
    return {name: np.array(grams, dtype=np.uint64) for name, grams in sorted(found.items())}


class RankOrder:
    """Profiles laid out for comparison: every profiled n-gram with its rank in each language."""

    def __init__(self, profiles: dict[str, np.ndarray], most: int = PROFILE):
        self.names, self.most = list(profiles), most
        self.grams = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *profiles.values()]))
        self.ranks = np.full((self.grams.size, len(self.names)), -1, dtype=np.int32)
        for k, grams in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.grams, grams), k] = np.arange(grams.size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language and how far its distance lies below the largest possible one, 0 to 1.

        A tie goes to the first name in alphabetical order.
        """
        keys, counts = ngram_counts(text)
        if not keys.size or not self.names:
            return UNKNOWN, 0.0
        own = ranked(keys, counts, self.most)
        at = np.minimum(np.searchsorted(self.grams, own), self.grams.size - 1)
        known = self.grams[at] == own
        places = self.ranks[at[known]]
        away = np.where(places < 0, self.most, np.abs(places - np.flatnonzero(known)[:, None]))
        distance = away.sum(axis=0) + self.most * int(own.size - known.sum())
        best = int(np.argmin(distance))
        return self.names[best], float(max(0.0, 1.0 - distance[best] / (self.most * own.size)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", most: int = PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred`` (a profiled language, or ``und`` for a text that is
    null or has no letter, or if there are no profiles) and ``score`` double.

    Narrow: no shuffle; repeated rows each give a row; other columns pass
    through, but for ones called ``lang_pred`` or ``score``, which are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = RankOrder(profiles, most)
        for batch in slices(batches, text):
            found = [model.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(released(run), schema)


def held_out_fold(key: str = "doc_id"):
    """Column: whether a document is kept from learning."""
    return fold(key, 3) == 1
