"""Request shaping: conversation assembly, authentication, routing, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardframe.plans.config import Limits


def totals(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation ``n_messages``, ``n_bytes`` and the last message's text, from partial sums:
    however long a conversation is, a task holds one message of it."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    last = F.max_by(F.struct(F.col(role).alias("role"), F.col(text).alias("content")), F.struct(F.col(turn), F.col(role)))
    return turns.groupBy(key).agg(F.count("*").alias("n_messages"), F.sum(size).cast("long").alias("n_bytes"), last.alias("last"))


def conversations(turns: DataFrame, limits: Limits | None = None, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``messages`` (turn, role, content) in order.

    A conversation is one request, so its turns have to meet in one row. With
    ``limits``, those beyond them are refused before anything is gathered and have
    no row, so the limits bound a row's size.
    """
    message = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    if limits is not None:
        within = totals(turns, key, turn, role, text).where(limit_error(F.col("n_messages"), F.col("n_bytes"), limits).isNull())
        turns = turns.join(within.select(key), key, "left_semi")
    return turns.groupBy(key).agg(F.sort_array(F.collect_list(message)).alias("messages"))


def system_prompts(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, ``system_prompt``): the system messages of each conversation joined by line feeds in order.

    Only system messages are gathered; leading empty ones add no line.
    """
    own = turns.where(F.col(role) == "system").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(turn), F.coalesce(F.col(text), F.lit("")).alias("content")))).alias("__own"))
    texts = F.transform("__own", lambda m: m["content"])
    joined = F.aggregate(texts, F.lit(""), lambda acc, x: F.when(acc == "", x).otherwise(F.concat(acc, F.lit("\n"), x)))
    return own.select(key, joined.alias("system_prompt"))


def last_content(messages: Column) -> Column:
    """The text that is judged: the last message's, whatever its role."""
    return F.try_element_at(messages, F.lit(-1))["content"]


def message_bytes(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + F.octet_length(F.coalesce(m["content"], F.lit(""))))


def limit_error(count: Column, size: Column, limits: Limits) -> Column:
    """Why a request is refused (null if it isn't): too many messages, then too many bytes."""
    return F.when(count > limits.messages, "too_many_messages").when(size > limits.message_bytes, "messages_too_large")


def normalized_role(role: Column) -> Column:
    """Trimmed and in small letters; user if it is blank."""
    low = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    return F.when(low == "", "user").otherwise(low)


def bearer_token(header: Column) -> Column:
    """The token of ``Bearer <token>``: two fields, the scheme in any case; else null."""
    fields = F.filter(F.split(F.coalesce(header, F.lit("")), r"\s+"), lambda x: x != "")
    return F.when((F.size(fields) == 2) & (F.lower(F.try_element_at(fields, F.lit(1))) == "bearer"), F.try_element_at(fields, F.lit(2)))


def is_true(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("1", "true", "t", "yes", "y", "on")


def authenticated(requests: DataFrame, keys: DataFrame, key: str = "api_key") -> DataFrame:
    """``requests`` with ``project_id`` and ``status`` (200, or 401 for an unknown key).

    ``keys`` (api_key, project_id, provider) is a dimension: Spark broadcasts it
    below its own size threshold and shuffles both sides beyond it.
    """
    found = requests.join(keys.select(F.col("api_key").alias("__key"), "project_id", "provider"), F.col(key) == F.col("__key"), "left").drop("__key")
    return found.withColumn("status", F.when(F.col("project_id").isNull(), 401).otherwise(200))


def repeated_keys(keys: DataFrame) -> DataFrame:
    """Keys that more than one project claims, which is a configuration error."""
    return keys.groupBy("api_key").agg(F.count("*").alias("projects")).where("projects > 1")


def routed(requests: DataFrame, default_provider: str) -> DataFrame:
    """``provider_id``: the project's provider, else the default."""
    return requests.withColumn("provider_id", F.coalesce(F.when(F.trim("provider") != "", F.col("provider")), F.lit(default_provider)))


def model_allowed(model: Column, project_models: Column, provider_models: Column) -> Column:
    """Whether a model may be used: the project's list counts, else the provider's; an
    empty model or two empty lists allow it. List entries are trimmed."""
    listed = lambda models: F.exists(models, lambda m: F.trim(m) == model)
    filled = lambda models: F.coalesce(F.size(models) > 0, F.lit(False))
    return (F.coalesce(model, F.lit("")) == "") | F.when(filled(project_models), listed(project_models)).when(filled(provider_models), listed(provider_models)).otherwise(True)
