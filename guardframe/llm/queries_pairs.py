"""Queries of the operators that compare rows with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardframe.llm.common import table


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guardframe.llm.neardup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guardframe.llm.ann import build_index, search

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(build_index(vectors, 5), vectors.where(F.col("vec_id") % 50 == 0), 5)
