"""From raw documents to token ids: five corpus operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All stages but
the last return the columns of the documents they were given, whatever their
names; of these they use ``doc_id`` and ``text``, the first also ``lang``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardframe.llm.bpe import encode_decode
from guardframe.llm.common import materialise, numbered, table
from guardframe.llm.decontaminate import without_overlaps
from guardframe.llm.langid import UNKNOWN, held_out_fold, identify, learn_profiles
from guardframe.llm.neardup import BROADCAST_IDS, near_duplicates
from guardframe.llm.queries_text import vocabulary_path
from guardframe.llm.secrets import scan

#: What stands in a text for a secret.
MASK = "[SECRET]"

#: The stages learn, count and compare; SQL can't express the whole.
ORACLE_SQL: str | None = None


def _aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The documents with other names for all columns but ``doc_id`` and ``text``, so that none is
    taken for an operator's own, and what gives the columns and their names back."""
    names = {c: c if c in ("doc_id", "text") else f"__own{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), lambda df: df.select(*(F.col(n).alias(c) for c, n in names.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null texts and texts without letters."""
    profiles = learn_profiles(docs.where(~F.coalesce(held_out_fold(), F.lit(False))))
    own, back = _aside(docs)
    return back(identify(own, profiles).where(F.col("lang_pred") != UNKNOWN))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group (five-word shingles, similarity 0.8 or more): that
    with the least id. Every row is a document of its own, also one that shares its id or has none;
    of rows with equal ids an earlier one stays."""
    rows = numbered(docs, "__row")
    found = materialise(near_duplicates(rows, "__row", size=5, percent=80).select("__row", F.col("component_id").alias("__group")), "groups")
    others = found.where(F.col("__row") != F.col("__group"))
    members = others.unionAll(others.select(F.col("__group").alias("__row"), "__group").distinct()).join(rows.select("__row", "doc_id"), "__row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    best = members.groupBy("__group").agg(F.min(order)["row"].alias("__row"))
    stays = best.select("__row")
    dropped = materialise(members.select("__row").join(stays, "__row", "left_anti"), "dropped")
    few = dropped.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(dropped) if few else dropped, "__row", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a passage with the benchmark."""
    return without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts, and gives ``n_chars``, where there is one, their length; no document goes."""
    own, back = _aside(docs)
    masked = back(scan(own, mask=MASK))
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32 bits each) of each document."""
    return encode_decode(docs, vocabulary_path()).select("doc_id", "n_tokens", "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
