"""The operators as SQL functions that stay inside Catalyst.

Bodies are SQL text over native functions, so queries that call them are planned,
pruned and compiled like any other.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from guardframe.functions import patterns as P
from guardframe.functions.dialect import java_pattern, sql_text
from guardframe.operators import detect, redact, toolgate
from guardframe.operators.responses import OUTPUT_KINDS


def _text(value: str) -> str:
    return sql_text(value).replace("\\", "\\\\")


def _pattern(pattern: str) -> str:
    return _text(java_pattern(pattern))


def _replaced(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {_pattern(pattern)}, {_text(replacement)})"


def _normalized(text: str) -> str:
    for pattern, replacement in P.SHELL_REWRITES:
        text = _replaced(text, pattern, replacement.replace("\\1", "$1"))
    quotes = "'\"`"
    return f"trim(regexp_replace(translate({text}, {_text(quotes)}, ''), '[\\\\s\\\\u0085\\\\u00a0\\\\u1680\\\\u2000-\\\\u200a\\\\u2028\\\\u2029\\\\u202f\\\\u205f\\\\u3000]+', ' '))"


def _url(u: str) -> str:
    part = lambda k: f"regexp_extract({u}, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)', {k})"
    last = f"regexp_extract(regexp_replace({part(3)}, '/$', ''), '(?s)([^/]*)/*$', 1)"
    where = f"concat(lower({part(1)}), '://', {part(2)}, '/')"
    return f"CASE WHEN {part(1)} = '' OR {part(2)} = '' THEN '[REDACTED_URL]' WHEN endswith({u}, '/') OR {last} IN ('', '.') THEN concat({where}, '[REDACTED_PATH]') ELSE concat({where}, {last}) END"


def _log_line(text: str, vendor: str) -> str:
    """The log redaction: the fixed patterns one after the other, then the URLs."""
    out = _replaced(text, P.AUTH_HEADER, "$1[REDACTED]")
    out = _replaced(out, P.BEARER, "$1[REDACTED]")
    out = _replaced(out, P.API_KEY_LIST, "$1REDACTED$3")
    out = _replaced(out, P.API_KEY_VALUE, "$1[REDACTED]")
    out = _replaced(out, rf"(?i){vendor}-[A-Za-z0-9-]+", f"{vendor.upper()}-[REDACTED]")
    licence = java_pattern(P.LICENSE_FIELD).replace(r"([^\t\n\f\r ]+)", r"(?![^\t\n\f\r ]*(?-iu:REDACTED))([^\t\n\f\r ]+)")
    out = f"regexp_replace({out}, {_text(licence)}, '$1[REDACTED]')"
    out = _replaced(out, P.PROVIDER_KEY, "$1[REDACTED]")
    out = _replaced(out, rf"(?i)({'|'.join(P.HEADER_KEY_NAMES)}|x-{vendor}-key){P.VALUE}", "$1[REDACTED]")
    out = _replaced(out, P.TOKENISH, "$1=[REDACTED]")
    pieces = f"zip_with(split(l, {_pattern(P.URL)}, -1), transform(regexp_extract_all(l, {_pattern(P.URL)}, 0), u -> {_url('u')}), (a, b) -> concat(a, coalesce(b, '')))"
    return f"(SELECT regexp_replace(array_join({pieces}, ''), '(\\\\[REDACTED\\\\]){{2,}}', '[REDACTED]') FROM (SELECT {out} AS l))"


def _kind(json: str, path: str = "$") -> str:
    return f"regexp_extract(schema_of_variant(variant_get(try_parse_json({json}), '{path}', 'variant')), '^[A-Z]+', 0)"


def _string(json: str, key: str) -> str:
    return f"CASE WHEN {_kind(json, f'$.{key}')} = 'STRING' THEN get_json_object({json}, '$.{key}') END"


_DATA = "array_join(transform(filter(split(c, '\\n'), x -> startswith(x, 'data:')), x -> regexp_replace(substring(x, 6), '^\\\\s+|\\\\s+$', '')), '\\n')"
#: A stream's events, as a table of place and data.
_EVENTS = f"SELECT pos, data FROM (SELECT pos, {_DATA} AS data FROM (SELECT posexplode(split(t, '\\n\\n')) AS (pos, c))) WHERE trim(data) <> '' AND data <> '[DONE]'"


def _stream_text() -> str:
    listed = "try_parse_json(concat('[', data, ']'))"
    parts = "flatten(transform(from_json(get_json_object(data, '$.response.output'), 'array<struct<content:array<struct<type:string,text:string>>>>'), i -> coalesce(i.content, array())))"
    kinds = ", ".join(map(sql_text, OUTPUT_KINDS))
    whole = f"array_join(transform(filter({parts}, p -> p.text IS NOT NULL AND p.type IN ({kinds})), p -> p.text), '')"
    kind, delta, text = _string("data", "type"), _string("data", "delta"), _string("data", "text")
    nested = f"CASE WHEN {_kind('data', '$.delta')} = 'OBJECT' AND {_kind('data', '$.delta.text')} = 'STRING' THEN get_json_object(data, '$.delta.text') END"
    piece = lambda said, is_delta: f"named_struct('text', {said}, 'delta', {is_delta})"
    case = (
        f"CASE WHEN ({kind}) = 'response.output_text.delta' AND ({delta}) IS NOT NULL THEN {piece(delta, 'true')} "
        f"WHEN ({kind}) = 'response.output_text.done' AND ({text}) IS NOT NULL THEN {piece(text, 'false')} "
        f"WHEN ({kind}) = 'response.completed' AND {_kind('data', '$.response')} = 'OBJECT' THEN {piece(whole, 'false')} "
        f"WHEN ({nested}) IS NOT NULL THEN {piece(nested, 'true')} "
        f"ELSE {piece('coalesce(' + _string('data', 'output_text') + ', ' + text + ')', 'false')} END"
    )
    valid = f"{listed} IS NOT NULL AND variant_get({listed}, '$[1]', 'variant') IS NULL"
    own = f"SELECT pos, p FROM (SELECT pos, {case} AS p FROM ({_EVENTS}) WHERE {valid}) WHERE p.text <> ''"
    gathered = f"SELECT sort_array(collect_list(struct(pos, p.text AS text, p.delta AS delta))) AS pieces FROM ({own})"
    deltas = "filter(pieces, x -> x.delta)"
    return f"(SELECT CASE WHEN size({deltas}) > 0 THEN array_join(transform({deltas}, x -> x.text), '') ELSE coalesce(try_element_at(pieces, 1).text, '') END FROM ({gathered}))"


def _segments() -> str:
    """A request body's input segments, as a table of place, role and text."""
    raw = "coalesce(get_json_object(t, '$.input'), get_json_object(t, '$.messages'))"
    role = "CASE WHEN trim(coalesce(i.role, '')) = '' THEN 'user' ELSE lower(trim(i.role)) END"
    segment = lambda r, x: f"named_struct('role', {r}, 'text', {x})"
    parts = "from_json(i.content, 'array<struct<type:string,text:string>>')"
    own = f"filter(array(CASE WHEN i.text IS NOT NULL THEN {segment(role, 'i.text')} END), s -> s IS NOT NULL)"
    below = f"CASE WHEN i.content IS NULL THEN filter({own}, s -> false) WHEN startswith(i.content, '[') THEN coalesce(transform(filter({parts}, p -> p.text IS NOT NULL), p -> {segment(role, 'p.text')}), filter({own}, s -> false)) ELSE array({segment(role, 'i.content')}) END"
    items = f"flatten(transform(from_json({raw}, 'array<struct<role:string,text:string,content:string>>'), i -> concat({own}, {below})))"
    one = segment("'user'", raw)
    found = f"CASE WHEN {_kind('t', '$.input')} = 'STRING' THEN array({one}) ELSE {items} END"
    return f"SELECT pos, s.role, s.text FROM (SELECT posexplode({found}) AS (pos, s))"


def bodies(vendor: str = "acme") -> dict[str, tuple[str, str]]:
    """Of each scalar function of one string ``t`` its type and body."""
    redacted = "t"
    for pattern, said, _ in redact.STEPS:
        redacted = _replaced(redacted, pattern, said)
    labels = ", ".join(f"CASE WHEN rlike(t, {_pattern(p)}) THEN {sql_text(name)} END" for name, p, _, _ in detect.LABELS)
    said = " OR ".join(f"rlike(t, {_pattern(toolgate.rule_pattern(p, exact, True))})" for _, _, p, exact in P.SHELL_RULES)
    read = f"(rlike(t, {_pattern(P.READ_VERBS)}) AND rlike(t, {_pattern(P.SENSITIVE_PATHS)}))"
    either = lambda p: f"(rlike(c, {p}) OR rlike(n, {p}))"
    blocks = " OR ".join([either(_pattern(toolgate.rule_pattern(p, exact))) for _, _, p, exact in P.SHELL_RULES] + [f"{either(_pattern(P.READ_VERBS))} AND {either(_pattern(P.SENSITIVE_PATHS))}"])
    return {
        "pii_labels": ("ARRAY<STRING>", f"filter(array({labels}), x -> x IS NOT NULL)"),
        "redact_pii": ("STRING", redacted),
        "redact_output": ("STRING", _replaced("t", P.OUTPUT_REDACTION, "[REDACTED]")),
        "redact_log": ("STRING", _log_line("t", vendor)),
        "normalize_shell": ("STRING", _normalized("t")),
        "tool_gate_action": ("STRING", f"(SELECT CASE WHEN trim(c) <> '' AND ({blocks}) THEN 'block' ELSE 'allow' END FROM (SELECT t AS c, {_normalized('t')} AS n))"),
        "guard_decision": ("STRING", f"CASE WHEN {said} OR {read} THEN 'warn' ELSE 'allow' END"),
        "sse_text": ("STRING", _stream_text()),
    }


def tables() -> dict[str, tuple[str, str]]:
    """Of each table function of one string ``t`` its columns and body."""
    return {"sse_events": ("pos INT, data STRING", _EVENTS), "segments": ("pos INT, role STRING, text STRING", _segments())}


def register(spark: SparkSession, vendor: str = "acme") -> list[str]:
    """Registers all as temporary functions and returns their names."""
    for name, (kind, body) in bodies(vendor).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    for name, (columns, body) in tables().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS TABLE ({columns}) RETURN {body}")
    return [*bodies(vendor), *tables()]
