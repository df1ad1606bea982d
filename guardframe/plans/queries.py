"""Queries of the safety dataflow over the supplied tables and literal cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardframe.functions import patterns as P
from guardframe.functions.dialect import sql_text
from guardframe.functions.strings import sql_matches, sql_replaced
from guardframe.operators import activation, detect, metrics, policy, redact, requests, responses, scoring, toolgate
from guardframe.plans import fixtures as X
from guardframe.plans.config import Category, Guard, Legacy, Limits, Security, ToolGate
from guardframe.plans.registry import ORACLES, query, rows, values
from guardframe.sources.tables import table

#: Banned words that occur in the documents.
WORDS = ("idiot", "trash", " Idiot ")
NO_PHONE = detect.Entities(phone=False)


def _pii_sql(text: str, phone: bool = True) -> str:
    for pattern, said, toggle in redact.STEPS:
        if phone or toggle != "phone":
            text = sql_replaced(text, pattern, said)
    return text


def _label_sql(text: str) -> str:
    """List of labels in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN {sql_matches(text, p)} THEN '{name}' END" for name, p, _, _ in detect.LABELS) + "], lambda x: x IS NOT NULL)"


def _hit_sql(text: str) -> dict[str, str]:
    anyone = " OR ".join(sql_matches(text, p) for _, p, _, _ in detect.LABELS)
    return {
        "pii": f"({anyone})",
        "secrets": sql_matches(text, P.TOKEN),
        "injection": f"({sql_matches(text, P.SQL_INJECTION)} OR {sql_matches(text, P.COMMAND_INJECTION)})",
        "prompt_injection": sql_matches(text, P.PROMPT_INJECTION),
        "jailbreak": sql_matches(text, P.JAILBREAK),
        "toxicity": sql_matches(text, P.TOXICITY),
    }


def _banned_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {sql_text(w.lower())})" for w in detect.banned_terms(words)) + ")"


_H = _hit_sql("text")
_SCAN = ", ".join([f"{_banned_sql('text', WORDS)} AS hit_banned_words", *(f"{sql} AS hit_{name}" for name, sql in _H.items())])


@query(f"SELECT doc_id, array_to_string({_label_sql('text')}, ',') AS labels, {_SCAN}, {_pii_sql('text')} AS redacted FROM documents")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.with_categories(table(spark, sf_dir, "documents").select("doc_id", "text"), words=WORDS)
    return found.withColumn("labels", F.array_join("labels", ",")).withColumn("redacted", redact.pii(F.col("text"), found=F.col("hit_pii"))).drop("text")


@query(f"SELECT id, {_banned_sql('text', X.BANNED)} AS hit_banned_words, array_to_string({_label_sql('text')}, ',') AS labels, {', '.join(f'{s} AS hit_{n}' for n, s in _H.items())} FROM {values('id, text', X.INPUT_CASES)}")
def scan_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.with_categories(rows(spark, "id string, text string", X.INPUT_CASES), words=X.BANNED)
    return found.withColumn("labels", F.array_join("labels", ",")).drop("text")


@query(f"SELECT doc_id, unnest({_label_sql('text')}) AS label FROM documents")
def pii_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(table(spark, sf_dir, "documents").select("doc_id", detect.pii_labels(F.col("text")).alias("labels")), "doc_id", "labels", "label")


@query(f"SELECT doc_id, {_pii_sql('text')} AS redacted FROM documents")
def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redact.pii(F.col("text")).alias("redacted"))


@query(f"SELECT doc_id, {_pii_sql('text', False)} AS redacted FROM documents")
def redact_pii_no_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redact.pii(F.col("text"), NO_PHONE).alias("redacted"))


@query(f"SELECT id, {_pii_sql('text')} AS redacted, {_pii_sql('text', False)} AS no_phone FROM {values('id, text', X.INPUT_CASES)}")
def redact_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return rows(spark, "id string, text string", X.INPUT_CASES).select("id", redact.pii(text).alias("redacted"), redact.pii(text, NO_PHONE).alias("no_phone"))


@query(f"SELECT doc_id, {sql_replaced('text', P.TOKEN, '[REDACTED_TOKEN]')} AS redacted FROM documents")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redact.secrets(F.col("text")).alias("redacted"))


@query(f"SELECT doc_id, {sql_replaced(sql_replaced('text', '(?i)idiot', '[REDACTED_BANNED]'), '(?i)trash', '[REDACTED_BANNED]')} AS redacted FROM documents")
def redact_banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redact.banned(F.col("text"), WORDS).alias("redacted"))


@query(f"SELECT conv_id, turn, {sql_replaced('text', P.OUTPUT_REDACTION, '[REDACTED]')} AS redacted, {sql_matches('text', P.OUTPUT_REDACTION)} AS hit FROM conversations WHERE role = 'assistant'")
def redact_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.select("conv_id", "turn", redact.output(F.col("text")).alias("redacted"), detect.output_hit(F.col("text")).alias("hit"))


_URL_PARTS = "regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)', ['s', 'h', 'p'])"


def _url_sql(u: str) -> str:
    parts = _URL_PARTS.replace("u,", f"{u},", 1)
    last = f"regexp_extract(regexp_replace({parts}.p, '/$', ''), '([^/]*)/*$', 1)"
    where = f"lower({parts}.s) || '://' || {parts}.h || '/'"
    return f"CASE WHEN {parts}.s = '' OR {parts}.h = '' THEN '[REDACTED_URL]' WHEN ends_with({u}, '/') OR {last} IN ('', '.') THEN {where} || '[REDACTED_PATH]' ELSE {where} || {last} END"


@query(f"SELECT page_id, {_url_sql('url')} AS redacted FROM pages")
def redact_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", redact.url(F.col("url")).alias("redacted"))


def _log_sql(text: str) -> str:
    out = sql_replaced(text, P.AUTH_HEADER, r"\1[REDACTED]")
    out = sql_replaced(out, P.BEARER, r"\1[REDACTED]")
    out = sql_replaced(out, P.API_KEY_LIST, r"\1REDACTED\3")
    out = sql_replaced(out, P.API_KEY_VALUE, r"\1[REDACTED]")
    out = sql_replaced(out, r"(?i)acme-[A-Za-z0-9-]+", "ACME-[REDACTED]")
    kept = f"CASE WHEN contains(regexp_extract({out}, {sql_text(P.LICENSE_FIELD)}, 2), 'REDACTED') THEN {out} ELSE {sql_replaced(out, P.LICENSE_FIELD, chr(92) + '1[REDACTED]')} END"
    return f"(SELECT {sql_replaced(sql_replaced(sql_replaced('k', P.PROVIDER_KEY, chr(92) + '1[REDACTED]'), '(?i)(x-api-key|x-acme-key)' + P.VALUE, chr(92) + '1[REDACTED]'), P.TOKENISH, chr(92) + '1=[REDACTED]')} FROM (SELECT {kept} AS k))"


_JOINED = f"list_reduce(list_transform(list_zip(string_split_regex(l, {sql_text(P.URL)}), regexp_extract_all(l, {sql_text(P.URL)})), lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' ELSE {_url_sql('z[2]')} END), lambda a, b: a || b)"


@query(rf"SELECT id, regexp_replace({_JOINED}, '(\[REDACTED\]){{2,}}', '[REDACTED]', 'g') AS redacted FROM (SELECT id, {_log_sql('text')} AS l FROM {values('id, text', X.LOG_CASES)})")
def redact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "id string, text string", X.LOG_CASES).select("id", redact.log_line(F.col("text")).alias("redacted"))


def _each(df: DataFrame, key: str, array: str, name: str) -> DataFrame:
    """A row for each element. The plain explode would have the optimizer test the array's size
    below, at the scan, with a copy of all that the array is made of."""
    return df.select(key, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def _signals_sql(source: str, key: str) -> str:
    branches = [f"SELECT {key}, CASE WHEN contains(l, 'token') THEN 'secrets' ELSE 'pii' END AS category, l AS evidence FROM (SELECT {key}, unnest({_label_sql('text')}) AS l FROM {source})"]
    branches += [f"SELECT {key}, '{c}', NULL FROM {source} WHERE {_H[c]}" for c in ("secrets", "injection", "prompt_injection", "jailbreak")]
    return " UNION ALL ".join(branches)


@query(f"SELECT doc_id, category, 'regex' AS source, CAST(1.0 AS DOUBLE) AS confidence, evidence FROM ({_signals_sql('documents', 'doc_id')})")
def signals_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _each(detect.with_signals(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "signals", "s")
    return found.select("doc_id", "s.category", "s.source", F.col("s.confidence").cast("double").alias("confidence"), "s.evidence")


def _hits_out(df: DataFrame, key: str, hits: str) -> DataFrame:
    out = _each(df, key, hits, "h")
    return out.select(key, "h.category", "h.action", F.round(F.col("h.confidence").cast("double"), 6).alias("confidence"), F.array_join("h.sources", ",").alias("sources"))


_REGEX_MERGED = {"prompt_injection": ("prompt_injection", "block"), "jailbreak": ("jailbreak", "block"), "pii": (None, "redact"), "secrets": ("secrets", "block_and_redact")}
_PII_ONLY = "(" + " OR ".join(sql_matches("text", p) for n, p, _, _ in detect.LABELS if n != "pii.token") + ")"


def _regex_policy_sql(source: str, key: str) -> str:
    parts = [f"SELECT {key}, '{c}' AS category, '{action}' AS action FROM {source} WHERE {_H[hit] if hit else _PII_ONLY}" for c, (hit, action) in _REGEX_MERGED.items()]
    return f"SELECT {key}, category, action, CAST(1.0 AS DOUBLE) AS confidence, 'regex' AS sources FROM ({' UNION ALL '.join(parts)})"


@query(_regex_policy_sql("documents", "doc_id"))
def policy_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = detect.with_signals(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _hits_out(docs.withColumn("hits", policy.merged_hits(F.col("signals"), Security())), "doc_id", "hits")


@query(_regex_policy_sql(values("id, text", X.INPUT_CASES), "id"))
def policy_regex_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = detect.with_signals(rows(spark, "id string, text string", X.INPUT_CASES))
    return _hits_out(cases.withColumn("hits", policy.merged_hits(F.col("signals"), Security())), "id", "hits")


#: Stand-in scores: one over 97, single precision, a function of the id.
_SCORE = {"prompt_injection": 7, "jailbreak": 11, "data_exfil_attempt": 13, "contains_personal_data": 17, "contains_secrets_maybe": 19}


def _scores(df: DataFrame) -> DataFrame:
    entries = [x for label, k in _SCORE.items() for x in (F.lit(label), ((F.col("doc_id") * k) % 97 / 97.0).cast("float"))]
    return df.withColumn("scores", F.create_map(*entries))


def _ml_policy_sql() -> str:
    score = lambda label: f"CAST((doc_id * {_SCORE[label]}) % 97 / 97.0 AS FLOAT)"
    gate = lambda label, x: f"{score(label)} >= CAST({x} AS FLOAT)"
    out = []
    for category, label, warn, block in (("prompt_injection", "prompt_injection", 0.6, 0.8), ("jailbreak", "jailbreak", 0.6, 0.8), ("data_exfil", "data_exfil_attempt", 0.55, 0.75)):
        out.append(f"SELECT doc_id, '{category}' AS category, CASE WHEN {gate(label, block)} THEN 'block' ELSE 'warn' END AS action, {score(label)} AS confidence FROM documents WHERE {gate(label, warn)}")
    out.append(f"SELECT doc_id, 'pii', 'log', {score('contains_personal_data')} FROM documents WHERE {gate('contains_personal_data', 0.5)}")
    label = "contains_secrets_maybe"
    out.append(f"SELECT doc_id, 'secrets', CASE WHEN {gate(label, 0.85)} THEN 'block_and_redact' ELSE 'log' END, {score(label)} FROM documents WHERE {gate(label, 0.5)}")
    return f"SELECT doc_id, category, action, round(CAST(confidence AS DOUBLE), 6) AS confidence, '{policy.ML_V1}' AS sources FROM ({' UNION ALL '.join(out)})"


@query(_ml_policy_sql())
def policy_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _scores(table(spark, sf_dir, "documents").select("doc_id"))
    hits = policy.merged_hits(policy.v1_signals(F.col("scores"), Security()), Security())
    return _hits_out(docs.withColumn("hits", hits), "doc_id", "hits")


_LEGACY = Legacy(pii="redact", words=X.BANNED, banned_words="redact")
_REASONS = {"injection": "prompt blocked or redacted due to possible injection", "prompt_injection": "prompt blocked or redacted due to possible prompt injection attempt", "jailbreak": "prompt blocked or redacted due to possible jailbreak attempt"}


def _banned_out(text: str) -> str:
    for word in X.BANNED:
        text = sql_replaced(text, f"(?i){word}", "[REDACTED_BANNED]")
    return text


def _legacy_sql(source: str, key: str, words, action: str) -> str:
    """The regex-only path: banned words are redacted (or block), personal data is redacted."""
    said = _banned_sql("text", words)
    banned = f"CASE WHEN {said} THEN {_banned_out('text')} ELSE text END" if action == "redact" else "text"
    content = f"CASE WHEN {_H['pii']} THEN {_pii_sql('b')} ELSE b END"
    blocks = [(said, "prompt blocked due to banned content")] if action == "block" else []
    reason = "CASE " + " ".join(f"WHEN {sql} THEN '{r}'" for sql, r in [*blocks, *((_H[c], r) for c, r in _REASONS.items())]) + " END"
    named = [("banned_words", said), *((c, _H[c]) for c in ("injection", "pii", "prompt_injection", "jailbreak", "toxicity"))]
    decisions = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql} THEN '{c}' END" for c, sql in named) + "], lambda x: x IS NOT NULL), ',')"
    return f"SELECT {key}, {decisions} AS decisions, {reason} AS block_reason, {reason} IS NOT NULL AS blocked, {content} AS content FROM (SELECT *, {banned} AS b FROM {source})"


def _legacy(df: DataFrame, key: str, legacy: Legacy) -> DataFrame:
    found = policy.before_model(df, Security(enabled=False), legacy)
    return found.select(key, F.array_join(F.transform("decisions", lambda h: h["category"]), ",").alias("decisions"), "block_reason", "blocked", "content")


@query(_legacy_sql(values("id, text", X.INPUT_CASES), "id", X.BANNED, "redact"))
def policy_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legacy(rows(spark, "id string, text string", X.INPUT_CASES), "id", _LEGACY)


@query(_legacy_sql("documents", "doc_id", WORDS, "block"))
def policy_legacy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legacy(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", Legacy(pii="redact", words=WORDS))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.totals(table(spark, sf_dir, "conversations")).select("conv_id", F.col("last.content").alias("text"))


_LAST = "(SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id)"
_SECURE_TOKEN = f"CASE WHEN {_H['secrets']} THEN {sql_replaced('p', P.TOKEN, '[REDACTED_TOKEN]')} ELSE p END"


def _before_sql() -> str:
    personal = f"CASE WHEN {_PII_ONLY} THEN {_pii_sql('text')} ELSE text END"
    first = [("prompt_injection", _H["prompt_injection"], "block"), ("jailbreak", _H["jailbreak"], "block"), ("pii", _PII_ONLY, "redact"), ("secrets", _H["secrets"], "block_and_redact"), ("injection", _H["injection"], "block"), ("toxicity", _H["toxicity"], "log")]
    decisions = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql} THEN '{c}={a}' END" for c, sql, a in first) + "], lambda x: x IS NOT NULL), ',')"
    reason = f"CASE WHEN {_H['prompt_injection']} THEN 'prompt blocked due to prompt_injection' WHEN {_H['jailbreak']} THEN 'prompt blocked due to jailbreak' WHEN {_H['secrets']} THEN 'prompt blocked due to secrets' WHEN {_H['injection']} THEN '{_REASONS['injection']}' END"
    return f"SELECT conv_id, {decisions} AS decisions, {reason} AS block_reason, {reason} IS NOT NULL AS blocked, {_SECURE_TOKEN} AS content FROM (SELECT *, {personal} AS p FROM {_LAST})"


@query(_before_sql())
def before_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = policy.before_model(_requests(spark, sf_dir), Security(), Legacy())
    decisions = F.array_join(F.transform("decisions", lambda h: F.concat_ws("=", h["category"], h["action"])), ",")
    return found.select("conv_id", decisions.alias("decisions"), "block_reason", "blocked", "content")


@query(f"SELECT conv_id, turn, {sql_replaced('text', P.OUTPUT_REDACTION, '[REDACTED]')} AS output, CASE WHEN {sql_replaced('text', P.OUTPUT_REDACTION, '[REDACTED]')} <> text THEN 'redacted' ELSE 'allow' END AS post_decision FROM conversations WHERE role = 'assistant'")
def after_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.after_model(table(spark, sf_dir, "conversations").where("role = 'assistant'")).select("conv_id", "turn", "output", "post_decision")


@query(f"SELECT conv_id, turn, CASE WHEN h THEN {_pii_sql('text')} ELSE text END AS updated, CASE WHEN h THEN 'redact' END AS action, h AND {_pii_sql('text')} <> text AS changed FROM (SELECT *, trim(text) <> '' AND {_H['pii']} AS h FROM conversations WHERE role = 'assistant')")
def response_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return policy.response_pii(turns, Security().pii).select("conv_id", "turn", "updated", "action", "changed")


@query(f"SELECT doc_id, CASE WHEN h AND {_pii_sql('text')} <> text THEN 'redact' WHEN h THEN 'warn' END AS action FROM (SELECT *, {_H['pii']} AS h FROM documents)")
def response_pii_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = Category(warn=0.5, block=0.0, on_regex="block")
    return policy.response_pii(table(spark, sf_dir, "documents"), cfg).select("doc_id", "action")


@query("SELECT conv_id, n AS n_messages, b AS n_bytes, CASE WHEN n > 6 THEN 'too_many_messages' WHEN b > 4000 THEN 'messages_too_large' END AS error FROM (SELECT conv_id, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS b FROM conversations GROUP BY conv_id)")
def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = requests.totals(table(spark, sf_dir, "conversations")).select("conv_id", "n_messages", "n_bytes")
    return found.withColumn("error", requests.limit_error(F.col("n_messages"), F.col("n_bytes"), Limits(messages=6, message_bytes=4000)))


@query("SELECT conv_id, count(*) AS n_messages, string_agg(role || ':' || strlen(text), ' ' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id HAVING count(*) <= 6 AND sum(strlen(text)) <= 4000")
def requests_within_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = requests.conversations(table(spark, sf_dir, "conversations"), Limits(messages=6, message_bytes=4000))
    said = F.transform("messages", lambda m: F.concat_ws(":", m["role"], F.octet_length(m["content"])))
    return found.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(said, " ").alias("messages"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS system_prompt FROM conversations WHERE role = 'system' GROUP BY conv_id")
def system_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.system_prompts(table(spark, sf_dir, "conversations")).where("system_prompt <> ''")


#: api_key, project_id, provider
KEYS = [("k0", "p0", "openai"), ("k1", "p1", ""), ("k2", "p2", "echo"), ("k3", "p3", "mock")]


@query(f"SELECT conv_id, project_id, CASE WHEN project_id IS NULL THEN 401 ELSE 200 END AS status, CASE WHEN trim(provider) <> '' THEN provider ELSE 'fallback' END AS provider_id FROM (SELECT DISTINCT conv_id, 'k' || CAST(conv_id % 5 AS VARCHAR) AS key FROM conversations) LEFT JOIN {values('api_key, project_id, provider', KEYS)} ON key = api_key")
def auth_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("k"), (F.col("conv_id") % 5).cast("string")).alias("api_key")).distinct()
    found = requests.authenticated(asked, rows(spark, "api_key string, project_id string, provider string", KEYS))
    return requests.routed(found, "fallback").select("conv_id", "project_id", "status", "provider_id")


@query("SELECT conv_id, model, CASE WHEN model = '' THEN true WHEN conv_id % 3 = 0 THEN model IN ('m0', 'm1') WHEN conv_id % 3 = 1 THEN model IN ('m2') ELSE true END AS allowed FROM (SELECT DISTINCT conv_id, CASE WHEN conv_id % 7 = 6 THEN '' ELSE 'm' || CAST(conv_id % 4 AS VARCHAR) END AS model FROM conversations)")
def model_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("conv_id")
    model = F.when(n % 7 == 6, "").otherwise(F.concat(F.lit("m"), (n % 4).cast("string")))
    asked = table(spark, sf_dir, "conversations").select("conv_id", model.alias("model")).distinct()
    none = F.array().cast("array<string>")
    own, provider = F.when(n % 3 == 0, F.array(F.lit(" m0"), F.lit("m1"))).otherwise(none), F.when(n % 3 == 1, F.array(F.lit("m2 "))).otherwise(none)
    return asked.withColumn("allowed", requests.model_allowed(F.col("model"), own, provider))


@query(f"SELECT id, CASE WHEN regexp_matches(trim(header), '(?i)^bearer\\s+\\S+$') THEN regexp_extract(trim(header), '(\\S+)$', 1) END AS token FROM {values('id, header', X.BEARER_CASES)}")
def bearer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "id string, header string", X.BEARER_CASES).select("id", requests.bearer_token(F.col("header")).alias("token"))


_STR = lambda key: f"CASE WHEN json_type(args, '$.{key}') = 'VARCHAR' THEN json_extract_string(args, '$.{key}') END"
_COMMAND = f"coalesce({_STR('command')}, {_STR('cmd')}, {_STR('shell_command')}, '')"
_TYPE = f"CASE WHEN coalesce(type, '') <> '' THEN type WHEN starts_with(lower(trim(name)), 'filesystem.') THEN 'filesystem' WHEN starts_with(lower(trim(name)), 'http') THEN 'http' WHEN contains(lower(name), 'shell') OR lower(trim(name)) IN ('bash', 'sh') THEN 'shell' WHEN lower(trim(name)) = 'nodes.run' THEN lower(coalesce(json_extract_string(args, '$.tool_type'), '')) ELSE '' END"


def _normal_sql(command: str) -> str:
    for pattern, replacement in P.SHELL_REWRITES:
        command = sql_replaced(command, pattern, replacement)
    bare = f"translate({command}, " + sql_text("'\"`") + ", '')"
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'))"


_CALLS = f"(SELECT id, t, c, {_normal_sql('c')} AS n, name, args FROM (SELECT *, {_TYPE} AS t, {_COMMAND} AS c FROM {values('id, name, type, args', X.TOOL_CALLS)}))"


def _shell_sql(mode: str) -> str:
    either = lambda p: f"({sql_matches('c', p)} OR {sql_matches('n', p)})"
    parts = [f"SELECT id, '{r}' AS rule_id, '{c}' AS category, '{toolgate.rule_action(c, mode)}' AS action FROM calls WHERE t = 'shell' AND trim(c) <> '' AND {either(toolgate.rule_pattern(p, e))}" for r, c, p, e in P.SHELL_RULES]
    parts.append(f"SELECT id, 'read_sensitive_files', 'data_exfil', 'block' FROM calls WHERE t = 'shell' AND {either(P.READ_VERBS)} AND {either(P.SENSITIVE_PATHS)}")
    return f"WITH calls AS {_CALLS} " + " UNION ALL ".join(parts)


_COMMANDS = f"(SELECT conv_id, turn, text AS c, {_normal_sql('text')} AS n FROM conversations)"


def _turns_sql() -> str:
    either = lambda p: f"({sql_matches('c', p)} OR {sql_matches('n', p)})"
    parts = [f"SELECT conv_id, turn, '{r}' AS rule_id, '{toolgate.rule_action(c, 'all_tools')}' AS action FROM calls WHERE trim(c) <> '' AND {either(toolgate.rule_pattern(p, e))}" for r, c, p, e in P.SHELL_RULES]
    parts.append(f"SELECT conv_id, turn, 'read_sensitive_files', 'block' FROM calls WHERE trim(c) <> '' AND {either(P.READ_VERBS)} AND {either(P.SENSITIVE_PATHS)}")
    return f"WITH calls AS {_COMMANDS}, hits AS ({' UNION ALL '.join(parts)}) SELECT calls.conv_id, calls.turn, n AS normalized, coalesce(h.rules, '') AS rules, coalesce(h.action, 'allow') AS action FROM calls LEFT JOIN (SELECT conv_id, turn, string_agg(rule_id, ',' ORDER BY rule_id) AS rules, CASE WHEN bool_or(action = 'block') THEN 'block' ELSE 'warn' END AS action FROM hits GROUP BY ALL) h USING (conv_id, turn)"


@query(_turns_sql())
def toolgate_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool gate over whole tables: every turn's text as a shell command."""
    calls = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("shell").alias("name"), F.lit("shell").alias("type"), F.to_json(F.struct(F.col("text").alias("command"))).alias("args"), "text")
    found = toolgate.judge(calls, ToolGate(mode="all_tools"))
    rules = F.array_join(F.array_sort(F.transform("hits", lambda h: h["rule_id"])), ",")
    return found.select("conv_id", "turn", toolgate.normalized_shell(F.col("text")).alias("normalized"), rules.alias("rules"), "action")


def _calls(spark: SparkSession) -> DataFrame:
    return rows(spark, "id string, name string, type string, args string", X.TOOL_CALLS)


def _call_hits(df: DataFrame) -> DataFrame:
    return df.select("id", F.explode("hits").alias("h")).select("id", "h.rule_id", "h.category", "h.action")


@query(_shell_sql("elevated_only"))
def toolgate_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _call_hits(toolgate.judge(_calls(spark).where("name not like 'http%' and lower(name) not like 'filesystem%'"), ToolGate()))


@query(_shell_sql("all_tools"))
def toolgate_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _call_hits(toolgate.judge(_calls(spark).where("name not like 'http%' and lower(name) not like 'filesystem%'"), ToolGate(mode="all_tools")))


_LARGE = f"(strlen(coalesce(json_extract_string(args, '$.body'), '')) > 4096 OR {sql_matches(chr(99) + 'oalesce(json_extract_string(args, ' + chr(39) + '$.body' + chr(39) + '), ' + chr(39) * 2 + ')', P.BASE64_RUN)})"
_HTTP_BAD = f"t = 'http' AND upper(trim(json_extract_string(args, '$.method'))) IN ('POST', 'PUT', 'PATCH') AND NOT contains(lower(json_extract_string(args, '$.url')), '//good.example.com:') AND {_LARGE}"


@query(f"WITH calls AS {_CALLS} SELECT id, CASE WHEN {_HTTP_BAD} THEN 'block' ELSE 'allow' END AS action, CASE WHEN {_HTTP_BAD} THEN 'http_large_body_exfil' END AS rule_id FROM calls WHERE t = 'http'")
def toolgate_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toolgate.judge(_calls(spark).where("name like 'http%'"), ToolGate(hosts=(" good.example.com ",)))
    return found.select("id", "action", F.col("primary.rule_id").alias("rule_id"))


_FS_BAD = f"lower(trim(name)) = 'filesystem.read' AND {sql_matches('args', P.SENSITIVE_PATHS)}"


@query(f"SELECT id, CASE WHEN {_FS_BAD} THEN 'block' ELSE 'allow' END AS action FROM {values('id, name, type, args', X.TOOL_CALLS)} WHERE lower(name) LIKE 'filesystem%'")
def toolgate_fs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolgate.judge(_calls(spark).where("lower(name) like 'filesystem%'"), ToolGate()).select("id", "action")


@query(f"WITH calls AS {_CALLS} SELECT id, n AS normalized FROM calls WHERE t = 'shell'")
def shell_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark).withColumn("t", toolgate.tool_type(F.col("name"), F.col("type"), F.col("args"))).where("t = 'shell'")
    return calls.select("id", toolgate.normalized_shell(toolgate.shell_command(F.col("args"))).alias("normalized"))


_ORDER = "CASE rule_id " + " ".join(f"WHEN '{r[0]}' THEN {i}" for i, r in enumerate(P.SHELL_RULES)) + " ELSE 99 END"


@query(f"SELECT id, arg_min(rule_id, {_ORDER} + CASE WHEN action = 'block' THEN 0 ELSE 1000 END) AS rule_id, CASE WHEN bool_or(action = 'block') THEN 'block' ELSE 'warn' END AS action FROM ({_shell_sql('all_tools')}) GROUP BY id")
def primary_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark).where("name not like 'http%' and lower(name) not like 'filesystem%'")
    found = toolgate.judge(calls, ToolGate(mode="all_tools")).where(F.col("primary").isNotNull())
    return found.select("id", F.col("primary.rule_id").alias("rule_id"), "action")


def _guard_sql(source: str, key: str) -> str:
    parts = [f"SELECT {key}, '{r}' AS rule_id, '{toolgate.INSTRUCTIONS[c]}' AS category FROM {source} WHERE {sql_matches('text', toolgate.rule_pattern(p, e, True))}" for r, c, p, e in P.SHELL_RULES]
    parts.append(f"SELECT {key}, 'read_sensitive_files', 'data_exfil_instruction' FROM {source} WHERE {sql_matches('text', P.READ_VERBS)} AND {sql_matches('text', P.SENSITIVE_PATHS)}")
    return " UNION ALL ".join(parts)


@query(_guard_sql(values("id, text", X.GUARD_CASES), "id"))
def response_guard_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toolgate.guard(rows(spark, "id string, text string", X.GUARD_CASES), Guard())
    return found.select("id", F.explode("guard_hits").alias("h")).select("id", "h.rule_id", "h.category")


@query(f"SELECT conv_id, turn, CASE WHEN n > 0 THEN 'warn' ELSE 'allow' END AS decision, CASE WHEN n > 0 THEN 'unsafe_instruction_detected' ELSE '' END AS note, n AS n_hits FROM (SELECT conv_id, turn, (SELECT count(*) FROM ({_guard_sql('(SELECT c.text AS text) AS one', '1')})) AS n FROM conversations c WHERE role = 'assistant')")
def response_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toolgate.guard(table(spark, sf_dir, "conversations").where("role = 'assistant'"), Guard())
    return found.select("conv_id", "turn", "decision", "note", F.size("guard_hits").cast("long").alias("n_hits"))


@query("SELECT l.toxic, regexp_matches(d.text, " + sql_text(P.TOXICITY) + ") AS hit, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2")
def toxicity_vs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The hit is found before the join, so only a boolean is shuffled, not the text.
    docs = table(spark, sf_dir, "documents").select("doc_id", detect.categories(F.col("text"))["toxicity"].alias("hit"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("toxic", "hit").agg(F.count("*").alias("n"))


_STATS = ", ".join(f"count({v}) AS {n}_n, round(sum({v}), 4) AS {n}_sum, min({v}) AS {n}_least, max({v}) AS {n}_most" for n, v in (("duration", "value"), ("upstream", "CASE WHEN event_id % 3 = 0 AND value > 0 THEN value END"), ("inference", "CASE WHEN event_id % 4 = 0 AND value > 0 THEN value END")))


@query(f"SELECT event_type AS decision, user_id % 5 AS project, count(*) AS requests, CAST(sum(CASE WHEN event_id % 3 > 0 THEN event_id % 3 END) AS BIGINT) AS policy_hits, {_STATS} FROM events GROUP BY 1, 2")
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda n: F.when(F.col("event_id") % n == 0, F.col("value")).otherwise(0.0)
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("decision"), (F.col("user_id") % 5).alias("project"), (F.col("event_id") % 3).alias("hits"), F.col("value").alias("duration_ms"), some(3).alias("upstream_ms"), some(4).alias("inference_ms"))
    found = metrics.request_metrics(events, "decision", "project")
    return found.withColumns({f"{n}_sum": F.round(f"{n}_sum", 4) for n in ("duration", "upstream", "inference")})


BOUNDS = (1.0, 5.0, 25.0, 100.0)


@query("SELECT event_type, CASE WHEN value <= 1 THEN 0 WHEN value <= 5 THEN 1 WHEN value <= 25 THEN 2 WHEN value <= 100 THEN 3 ELSE 4 END AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", metrics.bucket(F.col("value"), BOUNDS).alias("bucket"))
    return events.groupBy("event_type", "bucket").agg(F.count("*").alias("n"))


@query("SELECT event_type, round(avg(v), 6) AS avg, s[CAST(floor(len(s) * 0.5) AS BIGINT) + 1] AS p50, s[CAST(floor(len(s) * 0.95) AS BIGINT) + 1] AS p95 FROM (SELECT event_type, list_sort(list(value)) AS s, avg(value) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) GROUP BY event_type, s")
def bench_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.nearest_rank(table(spark, sf_dir, "events"), "value", (0.5, 0.95), ["event_type"])
    return found.withColumn("avg", F.round("avg", 6))


@query("SELECT user_id % 3 AS sink, count(*) AS enqueued, count(*) FILTER (o = 'ok') AS delivered, count(*) FILTER (o = 'failed') AS failed, count(*) FILTER (o = 'dropped') AS dropped FROM (SELECT user_id, CASE WHEN event_id % 10 = 0 THEN 'dropped' WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS o FROM events) GROUP BY 1")
def delivery_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_id") % 10 == 0, "dropped").when(F.col("event_type") == "error", "failed").otherwise("ok")
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("sink"), outcome.alias("outcome"))
    return metrics.delivery_counters(events, "outcome", "sink")


@query("SELECT user_id, string_agg(category || '=' || action, ',' ORDER BY category) AS decisions, string_agg(category || '=' || score, ',' ORDER BY category) AS scores, round(sum(latency_ms), 4) AS latency_ms FROM (SELECT user_id, event_type AS category, arg_min('a' || CAST(event_id % 3 AS VARCHAR), event_id) AS action, CAST(max(value * 100)::BIGINT AS VARCHAR) AS score, sum(value) AS latency_ms FROM events GROUP BY 1, 2) GROUP BY 1")
def segments_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("category"), F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string")).alias("action"), F.col("value").alias("score"), F.col("value").alias("latency_ms"))
    found = responses.merged_segments(events, "user_id", "event_id")
    listed = lambda m, said: F.array_join(F.transform(F.sort_array(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], said(e["value"]))), ",")
    return found.select("user_id", listed("decisions", lambda v: v).alias("decisions"), listed("scores", lambda v: F.rint(v * 100).cast("long").cast("string")).alias("scores"), F.round("latency_ms", 4).alias("latency_ms"))


@query("SELECT user_id, entity_type, start_byte, end_byte, source, min(event_id) AS first FROM (SELECT user_id, event_id, event_type AS entity_type, CAST(floor(value) AS BIGINT) % 9 AS start_byte, CAST(floor(value) AS BIGINT) % 9 + 4 AS end_byte, CASE WHEN event_id % 2 = 0 THEN 'regex' ELSE 'ner' END AS source FROM events) GROUP BY ALL")
def segment_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.floor("value") % 9
    found = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("entity_type"), start.alias("start_byte"), (start + 4).alias("end_byte"), F.when(F.col("event_id") % 2 == 0, "regex").otherwise("ner").alias("source"))
    return responses.merged_entities(found, "user_id", "event_id").withColumnRenamed("event_id", "first")


@query("SELECT user_id, string_agg(flag, ',' ORDER BY first, flag) AS flags FROM (SELECT user_id, event_type || CASE WHEN value > 50 THEN '_high' ELSE '_medium' END AS flag, min(event_id) AS first FROM events WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def segment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("value IS NOT NULL")
    flag = F.concat("event_type", F.when(F.col("value") > 50, "_high").otherwise("_medium"))
    return responses.merged_flags(events.select("user_id", "event_id", flag.alias("flag")), "user_id", "event_id").withColumn("flags", F.array_join("flags", ","))


@query("SELECT user_id, string_agg(name || '=' || score, ',' ORDER BY name) AS scores, bool_or(redacted) AS redacted, CASE WHEN bool_or(redacted) THEN 'redacted' ELSE 'allow' END AS decision, round(sum(latency_ms), 4) AS latency_ms FROM (SELECT user_id, event_type AS name, CAST((arg_max(value, event_id) * 100)::BIGINT AS VARCHAR) AS score, bool_or(event_id % 50 = 0) AS redacted, sum(value) AS latency_ms FROM events GROUP BY 1, 2) GROUP BY 1")
def post_check_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.col("value").alias("score"), (F.col("event_id") % 50 == 0).alias("redacted"), F.col("value").alias("latency_ms"))
    found = responses.post_checked(checks, "user_id")
    scores = F.transform(F.sort_array(F.map_entries("scores")), lambda e: F.concat_ws("=", e["key"], F.rint(e["value"] * 100).cast("long")))
    return found.select("user_id", F.array_join(scores, ",").alias("scores"), "redacted", "decision", F.round("latency_ms", 4).alias("latency_ms"))


_EACH = lambda source, json, path, key, name: f"SELECT *, unnest(json_extract({json}, '{path}')) AS {name}, generate_subscripts(json_extract({json}, '{path}'), 1) AS {key} FROM {source}"
_ROLE = "CASE WHEN trim(coalesce(json_extract_string(item, '$.role'), '')) = '' THEN 'user' ELSE lower(trim(json_extract_string(item, '$.role'))) END"
_BODY = f"(SELECT id, CAST(body AS JSON) AS j FROM {values('id, body', X.INPUT_BODIES)})"
_ITEM = f"(SELECT *, {_ROLE} AS role FROM ({_EACH(f'(SELECT id, coalesce(json_extract(j, {chr(39)}$.input{chr(39)}), json_extract(j, {chr(39)}$.messages{chr(39)})) AS a FROM {_BODY})', 'a', '$[*]', 'i', 'item')}))"
_SEGMENT = " UNION ALL ".join(
    (
        f"SELECT id, 0 AS i, 0 AS part, 0 AS k, 'user' AS role, json_extract_string(j, '$.input') AS text FROM {_BODY} WHERE json_type(j, '$.input') = 'VARCHAR'",
        f"SELECT id, i, 0, 0, role, json_extract_string(item, '$.text') FROM {_ITEM} WHERE json_type(item, '$.text') = 'VARCHAR'",
        f"SELECT id, i, 1, 0, role, json_extract_string(item, '$.content') FROM {_ITEM} WHERE json_type(item, '$.content') = 'VARCHAR'",
        f"SELECT id, i, 1, k, role, json_extract_string(p, '$.text') FROM ({_EACH(_ITEM, 'item', '$.content[*]', 'k', 'p')}) WHERE json_type(p, '$.text') = 'VARCHAR'",
    )
)
_WALK = f"SELECT id, role, text, ({_H['prompt_injection']} OR {_H['jailbreak']}) AS bad, row_number() OVER (PARTITION BY id ORDER BY i, part, k) - 1 AS segment FROM ({_SEGMENT})"


@query(f"SELECT id, segment, role, text FROM ({_WALK}) w WHERE NOT EXISTS (SELECT 1 FROM ({_WALK}) e WHERE e.id = w.id AND e.segment < w.segment AND e.bad)")
def responses_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = rows(spark, "id string, body string", X.INPUT_BODIES)
    found = bodies.select("id", F.posexplode(responses.input_segments(F.col("body")))).select("id", F.col("pos").alias("segment"), "col.role", "col.text")
    hits = detect.categories(F.col("text"))
    judged = found.withColumn("__blocked", hits["prompt_injection"] | hits["jailbreak"])
    return responses.until_block(judged, "id", "segment", "__blocked").drop("__blocked")


_OUT_BODY = f"(SELECT id, CAST(body AS JSON) AS j FROM {values('id, body', X.OUTPUT_BODIES)})"
_OUT_PART = _EACH(f"({_EACH(_OUT_BODY, 'j', '$.output[*]', 'i', 'item')})", "item", "$.content[*]", "k", "p")
_KINDS = ", ".join(sql_text(k) for k in responses.OUTPUT_KINDS)


@query(f"SELECT b.id, coalesce(t.texts, json_extract_string(b.j, '$.output_text'), '') AS texts FROM {_OUT_BODY} b LEFT JOIN (SELECT id, string_agg(json_extract_string(p, '$.text'), '|' ORDER BY i, k) AS texts FROM ({_OUT_PART}) WHERE json_type(p, '$.text') = 'VARCHAR' AND (trim(coalesce(json_extract_string(p, '$.type'), '')) = '' OR json_extract_string(p, '$.type') IN ({_KINDS})) GROUP BY id) t USING (id)")
def responses_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "id string, body string", X.OUTPUT_BODIES).select("id", F.array_join(responses.output_segments(F.col("body")), "|").alias("texts"))


_SSE_DATA = r"array_to_string(list_transform(list_filter(string_split(c, chr(10)), lambda x: starts_with(x, 'data:')), lambda x: regexp_replace(x[6:], '^\s+|\s+$', '', 'g')), chr(10))"
_SSE_EVENT = f"(SELECT id, n, CAST(d AS JSON) AS j FROM (SELECT id, n, {_SSE_DATA} AS d FROM (SELECT id, unnest(string_split(stream, chr(10) || chr(10))) AS c, generate_subscripts(string_split(stream, chr(10) || chr(10)), 1) AS n FROM {values('id, stream', X.SSE_CASES)})) WHERE trim(d) <> '' AND d <> '[DONE]' AND json_valid(d))"
_SSE_STRING = lambda key: f"CASE WHEN json_type(j, '$.{key}') = 'VARCHAR' THEN json_extract_string(j, '$.{key}') END"
_SSE_WHOLE = f"coalesce(array_to_string(list_transform(list_filter(flatten(list_transform(json_extract(j, '$.response.output[*]'), lambda o: json_extract(o, '$.content[*]'))), lambda p: json_extract_string(p, '$.type') IN ({_KINDS})), lambda p: json_extract_string(p, '$.text')), ''), '')"
_SSE_NESTED = "CASE WHEN json_type(j, '$.delta') = 'OBJECT' AND json_type(j, '$.delta.text') = 'VARCHAR' THEN json_extract_string(j, '$.delta.text') END"
_SSE_PIECE = f"""SELECT id, n, kind = 'response.output_text.delta' AND delta IS NOT NULL OR kind IS DISTINCT FROM 'response.output_text.done' AND kind IS DISTINCT FROM 'response.completed' AND nested IS NOT NULL AS is_delta,
 CASE WHEN kind = 'response.output_text.delta' AND delta IS NOT NULL THEN delta WHEN kind = 'response.output_text.done' AND t IS NOT NULL THEN t WHEN kind = 'response.completed' AND json_type(j, '$.response') = 'OBJECT' THEN {_SSE_WHOLE} WHEN nested IS NOT NULL THEN nested ELSE coalesce({_SSE_STRING('output_text')}, t, '') END AS text
 FROM (SELECT *, {_SSE_STRING('type')} AS kind, {_SSE_STRING('delta')} AS delta, {_SSE_STRING('text')} AS t, {_SSE_NESTED} AS nested FROM {_SSE_EVENT})"""


@query(f"SELECT id, coalesce(string_agg(text, '' ORDER BY n) FILTER (is_delta AND text <> ''), arg_min(text, n) FILTER (text <> ''), '') AS text FROM (SELECT id FROM {values('id, stream', X.SSE_CASES)}) LEFT JOIN ({_SSE_PIECE}) USING (id) GROUP BY id")
def sse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "id string, stream string", X.SSE_CASES).select("id", responses.sse_text(F.col("stream")).alias("text"))


_LOGITS = "(SELECT vec_id, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings)"


@query(f"SELECT vec_id, round(exp(l[1] - list_max(l)) / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))), 4) AS p0, list_position(l, list_max(l)) - 1 AS best, round(1 / (1 + exp(-l[1])), 4) AS sigmoid FROM {_LOGITS}")
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.slice("embedding", 1, 4)
    found = table(spark, sf_dir, "embeddings").select("vec_id", logits.alias("l"))
    return found.select("vec_id", F.round(F.element_at(scoring.softmax(F.col("l")), 1).cast("double"), 4).alias("p0"), scoring.argmax(F.col("l")).alias("best"), F.round(scoring.sigmoid(F.element_at("l", 1)).cast("double"), 4).alias("sigmoid"))


_NAMES = lambda label: f"(contains({label}, 'attack') OR contains({label}, 'unsafe') OR model = 'prompt_injection' AND contains({label}, 'injection') OR model = 'jailbreak' AND contains({label}, 'jailbreak'))"
_SAFE = lambda label: f"(contains({label}, 'safe') OR contains({label}, 'benign'))"
_OTHER = lambda label: f"NOT {_SAFE(label)} AND {label} NOT IN ('label_0', 'label_1')"
_ATTACK = f"CASE WHEN {_NAMES('a')} THEN CASE WHEN {_SAFE('a')} THEN 1 ELSE 0 END WHEN {_NAMES('b')} THEN CASE WHEN {_SAFE('b')} THEN 0 ELSE 1 END WHEN {_OTHER('a')} THEN 0 ELSE 1 END"


@query(f"SELECT id, attack, round(exp(l[attack + 1]) / (exp(l[1]) + exp(l[2])), 6) AS score FROM (SELECT *, {_ATTACK} AS attack FROM {values('id, l, model, a, b', [(i, l, m, n[0].lower(), n[1].lower()) for i, l, m, n in X.LOGIT_CASES])})")
def attack_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, logits, model, labels in X.LOGIT_CASES:
        attack = scoring.attack_class(model, labels)
        one = rows(spark, "id string, l array<float>", [(name, logits)])
        one = one.select("id", F.lit(attack).alias("attack"), F.round(scoring.sequence_score(F.col("l"), 2, attack).cast("double"), 6).alias("score"))
        out = one if out is None else out.unionAll(one)
    return out


def _flag_sql(label: str, warn: float, block: float) -> str:
    s = f"CAST((doc_id * {_SCORE[label]}) % 97 / 97.0 AS FLOAT)"
    return f"CASE WHEN {s} >= CAST({block} AS FLOAT) THEN '{label}_high' WHEN {s} >= CAST({warn} AS FLOAT) THEN '{label}_medium' END"


@query(f"SELECT doc_id, array_to_string(f, ',') AS flags, coalesce(f[1], 'clean') AS verdict FROM (SELECT doc_id, list_filter([{_flag_sql('prompt_injection', 0.6, 0.8)}, {_flag_sql('jailbreak', 0.6, 0.8)}], lambda x: x IS NOT NULL) AS f FROM documents)")
def score_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _scores(table(spark, sf_dir, "documents").select("doc_id"))
    found = docs.withColumn("f", scoring.flags(F.col("scores"), {"prompt_injection": (0.6, 0.8), "jailbreak": (0.6, 0.8)}))
    return found.select("doc_id", F.array_join("f", ",").alias("flags"), scoring.verdict(F.col("f")).alias("verdict"))


@query("SELECT * FROM " + values("id, entity_type, start_byte, end_byte", [("one", "EMAIL", 14, 30), ("touching", "EMAIL", 5, 15), ("inside", "NAME", 0, 8), ("inside", "CITY", 11, 15), ("skipped", "NAME", 0, 8), ("change", "NAME", 0, 3), ("change", "CITY", 4, 8), ("change", "name", 9, 12)]))
def bio_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = rows(spark, "id string, labels array<string>, offsets array<struct<start:int,end:int>>", X.BIO_CASES)
    return cases.select("id", F.explode(scoring.entities(F.col("labels"), F.col("offsets"))).alias("e")).select("id", "e.*")


@query("SELECT * FROM " + values("id, redacted", [("mail", "mail [REDACTED_EMAIL] ok"), ("bytes", "é phone [REDACTED_PHONE] é"), ("overlap", "ab[REDACTED_TOKEN]fghij"), ("invalid", "[REDACTED]bc")]))
def span_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = rows(spark, "id string, text string, spans array<struct<entity_type:string,start_byte:int,end_byte:int>>", [(i, t, [tuple(s.values()) for s in spans]) for i, t, spans in X.SPAN_CASES])
    return cases.select("id", redact.spans(F.col("text"), F.col("spans")).alias("redacted"))


def _event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.floor("value").cast("int")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("entity_type"), start.alias("start_byte"), (start + (F.col("event_id") % 4).cast("int") + 1).alias("end_byte"))


# Spans that occur twice would be ties in the two windows, which DuckDB may order differently.
@query("WITH s AS (SELECT DISTINCT user_id, event_type AS entity_type, CAST(floor(value) AS INTEGER) AS a, CAST(floor(value) AS INTEGER) + CAST(event_id % 4 AS INTEGER) + 1 AS b FROM events), o AS (SELECT *, max(b) OVER (PARTITION BY user_id, entity_type ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s), g AS (SELECT *, sum(CASE WHEN e IS NULL OR a > e THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, entity_type ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, entity_type, min(a) AS start_byte, max(b) AS end_byte FROM g GROUP BY user_id, entity_type, k")
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.merged_rows(_event_spans(spark, sf_dir), "user_id", "entity_type")


_DENY = " OR ".join(f"contains(lower(k), '{w}')" for w in activation.DENY_WORDS)
#: key, value
ATTRIBUTES = [("safe_key", "ok"), ("short_string", "fine"), ("project_id", "p1"), ("Prompt_text", "x"), ("content", "x"), ("my_api_key", "x"), ("token_count", "3"), ("authorization", "x"), ("long", "y" * 600), ("edge", "z" * 512)]


@query(f"SELECT k, v FROM {values('k, v', ATTRIBUTES)} WHERE NOT ({_DENY}) AND strlen(v) <= 512")
def safe_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = rows(spark, "m map<string,string>", [(dict(ATTRIBUTES),)])
    return one.select(F.explode(activation.safe_attributes(F.col("m"))).alias("k", "v"))


_HOST = r"CASE WHEN starts_with(host, '[') THEN regexp_extract(host, '^\[([^\]]*)\]', 1) WHEN len(host) - len(replace(host, ':', '')) = 1 THEN split_part(host, ':', 1) ELSE host END"
_NETS = r"^(::ffff:)?(127|10)(\.\d+){3}$|^(::ffff:)?172\.(1[6-9]|2\d|3[01])(\.\d+){2}$|^(::ffff:)?(192\.168|169\.254)(\.\d+){2}$|^::1$|^f[cd]..:|^fe[89ab].:|^localhost$"


@query(f"SELECT host, regexp_matches({_HOST}, {sql_text(_NETS)}) AS private FROM {values('host', X.HOST_CASES)}")
def ssrf_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "host string", X.HOST_CASES).select("host", activation.private_host(F.col("host")).alias("private"))


@query(f"SELECT has_key, outcome, version, has_key AND outcome = 'network_error' AND trim(version) <> '' AS cache, CASE WHEN NOT has_key THEN 'disabled_missing_license' WHEN outcome = 'invalid_license' THEN 'disabled_invalid_license' WHEN outcome = 'network_error' AND trim(version) <> '' THEN 'offline_cached_bundle' WHEN outcome = 'network_error' THEN 'disabled_missing_bundle' ELSE 'disabled_invalid_bundle' END AS status FROM {values('has_key, outcome, version', X.FALLBACK_CASES)}")
def fallback_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = rows(spark, "has_key boolean, outcome string, version string", X.FALLBACK_CASES)
    return cases.withColumn("f", activation.fallback(F.col("has_key"), F.col("outcome"), F.col("version"))).select("has_key", "outcome", "version", "f.cache", "f.status")


@query("SELECT * FROM " + values("category, warn, block", [("prompt_injection", 0.6, 0.8), ("jailbreak", 0.6, 0.8), ("data_exfil", 0.55, 0.75), ("pii", 0.5, None), ("secrets", 0.5, 0.85)]).replace("0.6,", "CAST(0.6 AS DOUBLE),", 1))
def thresholds_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "category string, warn double, block double", [(c, t.get("warn"), t.get("block")) for c, t in activation.thresholds(Security()).items()])


@query("WITH l AS (SELECT user_id AS request_id, event_id % 3 AS project_id, arg_max(event_type, ts) AS status, max(ts) AS ts FROM (SELECT DISTINCT ON (user_id, event_id % 3, ts) * FROM events ORDER BY user_id, event_id % 3, ts, event_type DESC) GROUP BY 1, 2) SELECT request_id, project_id, status FROM l WHERE epoch(ts)::BIGINT + 86400 > (SELECT epoch(max(ts))::BIGINT FROM events)")
def request_status_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guardframe.streaming.status import latest_status

    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), (F.col("event_id") % 3).alias("project_id"), F.col("event_type").alias("status"), "ts")
    now = events.agg(F.max("ts")).first()[0]
    return latest_status(events, F.lit(now), 86_400).select("request_id", "project_id", "status")
