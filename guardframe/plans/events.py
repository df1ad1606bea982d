"""Queries that build activation events from conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardframe.functions import patterns as P
from guardframe.functions.strings import rfc3339, sql_matches, sql_replaced
from guardframe.operators import activation, detect, policy, redact, tokenizers, toolgate
from guardframe.plans.config import Guard, Legacy, Security
from guardframe.plans.queries import _JOINED, _PII_ONLY, _guard_sql, _hit_sql, _log_sql, _pii_sql
from guardframe.plans.registry import query
from guardframe.sources.tables import table


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat path: the last user turn is the prompt, the last assistant turn the output.

    One shuffle, which keeps the last turns only; everything after it is narrow.
    Durations and provider errors are functions of the conversation's number.
    """
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    number = F.col("conv_id")
    found = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.coalesce(last("user"), F.lit("")).alias("prompt"), F.coalesce(last("assistant"), F.lit("")).alias("reply"))
    found = found.select(
        number.cast("string").alias("request_id"),
        F.concat(F.lit("p"), (number % 5).cast("string")).alias("project_id"),
        F.lit("echo").alias("provider"),
        F.lit("m").alias("model"),
        "prompt",
        "reply",
        (number % 13 == 0).alias("error"),
        *((number % n).cast("double").alias(name) for name, n in (("pre_ms", 7), ("provider_ms", 11), ("post_ms", 5))),
    )
    found = policy.before_model(found, Security(), Legacy(), "prompt")
    found = policy.after_model(found, "reply")
    found = toolgate.guard(found, Guard(), "reply").withColumn("prompt", F.col("content"))
    engine = activation.Engine(status="active", bundle_version="v7", cache_present=True, model_status="active", thresholds=activation.thresholds(Security()))
    return activation.events(found, engine=engine, now=F.lit("2024-05-06 07:08:09.25").cast("timestamp"))


_P, _R = _hit_sql("p"), sql_matches("r", P.OUTPUT_REDACTION)
_PERSONAL = _PII_ONLY.replace("(text,", "(p,")
_OUT = sql_replaced("r", P.OUTPUT_REDACTION, "[REDACTED]")
_TURNS = "(SELECT conv_id AS n, CAST(conv_id AS VARCHAR) AS request_id, 'p' || CAST(conv_id % 5 AS VARCHAR) AS project_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS p, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS r FROM conversations GROUP BY conv_id)"
_GUARDED = f"(SELECT *, coalesce((SELECT list(DISTINCT category) FROM ({_guard_sql('(SELECT t.r AS text) AS one', '1')})), []) AS g FROM {_TURNS} t)"
_BLOCKED = f"({_P['prompt_injection']} OR {_P['jailbreak']} OR {_P['secrets']} OR {_P['injection']})"
_ACTS = (("prompt_injection", _P["prompt_injection"], "block"), ("jailbreak", _P["jailbreak"], "block"), ("pii", _PERSONAL, "redact"), ("secrets", _P["secrets"], "block_and_redact"), ("injection", _P["injection"], "block"), ("toxicity", _P["toxicity"], "log"))
_listed = lambda parts: "list_filter([" + ", ".join(f"CASE WHEN {sql} THEN '{said}' END" for said, sql in parts) + "], lambda x: x IS NOT NULL)"
_CATEGORIES = f"array_to_string(list_sort(list_distinct(list_concat({_listed([(c, sql) for c, sql, a in _ACTS if a != 'log'])}, g))), ',')"
_SUMMARY = f"""SELECT request_id, project_id,
 CASE WHEN b THEN 'block' WHEN n % 13 = 0 THEN 'allow' WHEN personal THEN 'redact' ELSE 'allow' END AS request_final,
 CASE WHEN b OR n % 13 = 0 THEN 'block' WHEN o <> r THEN 'redact' WHEN len(g) > 0 THEN 'warn' ELSE 'allow' END AS response_final,
 CASE WHEN b OR n % 13 = 0 THEN CASE WHEN len(g) > 0 THEN 'unsafe_instruction_detected' END WHEN o <> r THEN 'redaction_applied' WHEN len(g) > 0 THEN 'unsafe_instruction_detected' WHEN n % 5 = 0 THEN 'skipped' END AS response_note,
 b AS blocked, {_CATEGORIES} AS categories FROM (SELECT *, {_BLOCKED} AS b, {_PERSONAL} AS personal, {_OUT} AS o FROM {_GUARDED})"""


@query(_SUMMARY)
def activation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_events(spark, sf_dir).select("request_id", "meta.project_id", "summary.*")
    return found.withColumn("categories", F.coalesce(F.array_join("categories", ","), F.lit("")))


_DOC_CATEGORIES = f"list_filter([{', '.join(f'CASE WHEN {sql} THEN {chr(39)}{c}{chr(39)} END' for c, sql in _hit_sql('text').items())}], lambda x: x IS NOT NULL)"


@query(f"SELECT category, count(*) AS n FROM (SELECT unnest({_DOC_CATEGORIES}) AS category FROM documents) GROUP BY category")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each category is found in."""
    found = detect.with_categories(table(spark, sf_dir, "documents").select("text"))
    named = F.array(*(F.when(F.col(f"hit_{c}"), F.lit(c)) for c in _hit_sql("text")))
    return found.select(F.explode_outer(named).alias("category")).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))


def _shown_sql(text: str) -> str:
    return sql_replaced(sql_replaced(text, P.PREVIEW_EMAIL, "[REDACTED_EMAIL]"), P.TOKEN, "[REDACTED_TOKEN]")


#: The log redaction of column ``l``, which is a text after the fixed patterns.
_CLEANED = rf"regexp_replace({_JOINED}, '(\[REDACTED\]){{2,}}', '[REDACTED]', 'g')"
_CONTENT = f"CASE WHEN secret THEN {sql_replaced('c', P.TOKEN, '[REDACTED_TOKEN]')} ELSE c END"
_EVENTS = f"""SELECT s.*, '2' AS version, 'non_stream' AS mode, array_to_string({_listed([(f'{c}={a}', sql) for c, sql, a in _ACTS])}, ',') AS request_hits,
 array_to_string(list_sort(g), ',') AS response_hits, CASE WHEN list_contains(g, 'data_exfil_instruction') THEN CAST(1 AS DOUBLE) END AS exfil_score,
 CAST(n % 7 AS DOUBLE) AS request_ms, CAST(n % 5 AS DOUBLE) AS response_ms, CAST(n % 11 AS DOUBLE) AS provider_ms, CAST(n % 7 + n % 11 + n % 5 AS DOUBLE) AS total_ms,
 CASE WHEN strlen(shown) <= 500 THEN {_CLEANED} END AS prompt, '2024-05-06T07:08:09.25Z' AS said_at, 'active' AS engine, 'guard_v1' AS engine_model, 5 AS limits
 FROM (SELECT *, {_log_sql('shown')} AS l FROM (SELECT *, {_shown_sql('content')} AS shown FROM (SELECT *, {_CONTENT} AS content FROM (SELECT *, {_P['secrets']} AS secret, CASE WHEN {_PERSONAL} THEN {_pii_sql('p')} ELSE p END AS c FROM {_GUARDED})))) JOIN ({_SUMMARY}) s USING (request_id)"""


@query(_EVENTS)
def activation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole event, column by column; long previews, which are cut within a character, are left out."""
    found = chat_events(spark, sf_dir)
    hits = lambda side, said: F.coalesce(F.array_join(F.transform(f"{side}.hits", said), ","), F.lit(""))
    prompt = F.col("request.preview.prompt")
    return found.select(
        "request_id",
        "meta.project_id",
        "summary.request_final",
        "summary.response_final",
        "summary.response_note",
        "summary.blocked",
        F.coalesce(F.array_join("summary.categories", ","), F.lit("")).alias("categories"),
        "version",
        "meta.mode",
        hits("request", lambda h: F.concat_ws("=", h["category"], h["action"])).alias("request_hits"),
        F.coalesce(F.array_join(F.array_sort(F.transform("response.hits", lambda h: h["category"])), ","), F.lit("")).alias("response_hits"),
        F.element_at("response.scores", "data_exfil_instruction").cast("double").alias("exfil_score"),
        F.col("request.latency_ms").alias("request_ms"),
        F.col("response.latency_ms").alias("response_ms"),
        F.col("timing_ms.provider").alias("provider_ms"),
        F.col("timing_ms.total").alias("total_ms"),
        F.when(~prompt.endswith("…"), prompt).alias("prompt"),
        rfc3339(F.col("timestamp")).alias("said_at"),
        F.col("intel.status").alias("engine"),
        F.col("intel.model_engine.model").alias("engine_model"),
        F.size("intel.thresholds").alias("limits"),
    )


@query(f"SELECT doc_id, strlen(shown) > 500 AS cut, CASE WHEN strlen(shown) <= 500 THEN {_CLEANED} END AS shown FROM (SELECT *, {_log_sql('shown')} AS l FROM (SELECT doc_id, {_shown_sql('text')} AS shown FROM documents))")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's preview; of those over the limit only that they are cut, as the cut may fall within a character."""
    long = F.octet_length(redact.preview(F.col("text"))) > 500
    return table(spark, sf_dir, "documents").select("doc_id", long.alias("cut"), F.when(~long, activation.preview(F.col("text"), "redacted")).alias("shown"))


#: A small vocabulary for the word-piece and unigram queries: frequent endings of the invented prose.
PIECES = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "the", "and", "of", "##ing", "##tion", "##er", "##ea", "##on", "th", "##th", "in", "an", "##an", "##es", "er", "es", "on", "##st", "##ly", "##ble")


def _word_piece() -> tokenizers.WordPiece:
    return tokenizers.WordPiece({p: i for i, p in enumerate(PIECES)}, tokenizers.Special(2, 3, 0, 1))


def _unigram() -> tokenizers.Unigram:
    pieces = [("<unk>", -10.0), ("<s>", 0.0), ("</s>", 0.0)] + [(p.replace("##", ""), -2.0 - len(p) / 10) for p in PIECES[4:]] + [("▁", -3.0)]
    return tokenizers.Unigram(list(dict(pieces).items()), tokenizers.Special(1, 2, 0, 0), byte_fallback=False)


@query()
def wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenizers.tokenized(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", _word_piece, 64)
    return found.select("conv_id", "turn", F.array_join("ids", " ").alias("ids"), F.aggregate("mask", F.lit(0).cast("long"), lambda n, x: n + x).alias("used"))


@query()
def unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenizers.tokenized(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", _unigram, 64)
    return found.select("conv_id", "turn", F.array_join("ids", " ").alias("ids"), F.aggregate("mask", F.lit(0).cast("long"), lambda n, x: n + x).alias("used"))
