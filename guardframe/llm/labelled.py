"""The bounded labelled sample that the two text classifiers learn from."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardframe.llm.common import fold, materialise

#: Labelled documents taken of each class at most. This bounds what the driver holds.
SAMPLE = 4000
#: Runs of letters.
_LETTERS = re.compile(r"[^\W\d_]+")


def letters_of(token: str) -> list[str]:
    """Small-letter runs of letters in a token."""
    return _LETTERS.findall(token.lower())


def hashed(gram: str, buckets: int) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % buckets


def held_out_fold(key: str = "doc_id") -> Column:
    """Column: whether a document is kept from learning."""
    return F.coalesce(fold(key, 5) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int], float]:
    """Labelled (key, text, y) rows, at most ``per_class`` of either class; how many there are of
    each class; and the log ratio by which the sample's odds of class 1 exceed those among all labels.

    The rows are those with the least hash of the id, so the choice doesn't
    depend on partitions. The ids (bounded) are broadcast; only the sample is
    shuffled. Of several labels for an id the largest counts, of several texts
    the least; labels that are neither 0 nor 1, and rows without an id, don't count.
    """
    known = materialise(labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out_fold(key)).groupBy(key).agg(F.max(label).cast("int").alias("y")), "labels")
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = known.where("false")
    for y in sorted(total):
        ids = ids.unionAll(known.where(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(per_class))
    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), key)
    rows = materialise(rows.groupBy(key).agg(F.min("text").alias("text"), F.max("y").alias("y")).select(F.col(key).cast("string").alias("key"), "text", "y"), "sample")
    taken = {y: min(n, per_class) for y, n in total.items()}
    shift = math.log(taken[1] / taken[0] / (total[1] / total[0])) if len(total) == 2 else 0.0
    return rows, {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}, shift


def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All rows' entries in one array, and where each row starts (reduceat style; no row may be empty)."""
    return np.concatenate(rows), np.cumsum([0, *(r.size for r in rows[:-1])])
