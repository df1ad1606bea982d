"""Queries of the operators that read one document at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardframe.llm.common import table


def vocabulary_path() -> str:
    """Where the public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guardframe.llm.bpe import encode_decode

    found = encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guardframe.llm.secrets import BASE_KINDS, count, joined, scan

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    return found.select("doc_id", *(count("spans", k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(joined("spans", BASE_KINDS), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guardframe.llm.langid import held_out_fold, identify, learn_profiles

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out_fold(), F.lit(False)))
    profiles = learn_profiles(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guardframe.llm.labelled import held_out_fold
    from guardframe.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guardframe.llm.labelled import held_out_fold
    from guardframe.llm.quality import learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out_fold().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guardframe.llm.decontaminate import find_overlaps, hit_words

    found = find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    n_hit, items = hit_words().alias("n_hit"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", n_hit, F.size("items").cast("long").alias("n_items"), items, (F.size("hits") > 0).alias("contaminated"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guardframe.llm.lm import held_out_fold, learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", held_out_fold().alias("held_out"), "text")
    counts, vocabulary, weights = learn(docs.where(~F.col("held_out")))
    found = score(docs, counts, vocabulary, weights)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guardframe.llm.html import extract

    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
