"""Tool gate and response guard: rules over tool calls and over model output.

Rules are expanded at plan time into an array of conditional structs, so a call
is judged in one pass within whole-stage code generation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardframe.functions import patterns as P
from guardframe.functions.strings import cut_bytes, first_match, matches, replaced
from guardframe.operators.redact import log_line
from guardframe.plans.config import Guard, ToolGate

INSTRUCTIONS = {"data_exfil": "data_exfil_instruction", "unsafe_action": "unsafe_action_instruction", "privilege_escalation": "privilege_escalation_instruction"}


#: A pattern that no text matches.
NEVER = r"[^\x{0}-\x{10FFFF}]"


def rule_pattern(pattern: str, exact: bool, dot_all: bool = False, instead: str | None = None) -> str:
    """A rule's pattern with its flags. If it can't be compiled, ``instead`` takes its place, or one that never matches."""
    flags = ("" if exact else "i") + ("s" if dot_all else "")
    for text in (pattern, instead):
        full = (f"(?{flags})" if flags else "") + (text or "")
        try:
            re.compile(re.sub(r"\(\?[a-z]+\)", "", full).replace(r"\z", r"\Z"))
        except re.error:
            continue
        if text is not None:
            return full
    return NEVER


def rules(shell_only: bool = True) -> list[dict[str, str]]:
    """The rules as a table: id, category, pattern; the built-in ones, which aren't single patterns, on request."""
    own = [{"rule_id": r, "category": c, "pattern": rule_pattern(p, e)} for r, c, p, e in P.SHELL_RULES]
    built_in = [{"rule_id": r, "category": "data_exfil", "pattern": ""} for r in ("read_sensitive_files", "http_large_body_exfil")]
    return own if shell_only else own + built_in


def normalized_shell(command: Column) -> Column:
    """A command without escapes, substitutions, variables and quotes, its white space collapsed."""
    for pattern, replacement in P.SHELL_REWRITES:
        command = replaced(command, pattern, replacement)
    bare = F.translate(command, "'\"`", "")
    return F.trim(F.regexp_replace(bare, r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def evidence(text: Column) -> Column:
    return cut_bytes(log_line(text), 120)


def tool_type(name: Column, given: Column, args: Column) -> Column:
    """The given type, else one told from the tool's name."""
    low = F.lower(F.trim(name))
    inferred = (
        F.when(low.startswith("filesystem."), "filesystem")
        .when(low.startswith("http"), "http")
        .when(low.contains("shell") | low.isin("bash", "sh"), "shell")
        .when(low == "nodes.run", F.lower(F.coalesce(F.get_json_object(args, "$.tool_type"), F.lit(""))))
        .otherwise("")
    )
    return F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(inferred)


def _string_arg(args: Column, key: str) -> Column:
    """A string argument; null if it is missing or of another type."""
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(args), f"$.{key}", "variant"))
    return F.when(kind == "STRING", F.get_json_object(args, f"$.{key}"))


def shell_command(args: Column) -> Column:
    """The first of the command arguments that holds a string, even an empty one."""
    return F.coalesce(*(_string_arg(args, key) for key in ("command", "cmd", "shell_command")), F.lit(""))


def path_arguments(args: Column) -> Column:
    """All path arguments, single or in lists, in the order of their keys."""
    out = []
    for key in ("path", "paths", "file", "files", "filename", "target"):
        listed = F.from_json(F.get_json_object(args, f"$.{key}"), "array<string>")
        out.append(F.when(_string_arg(args, key).isNotNull(), F.array(_string_arg(args, key))).otherwise(F.coalesce(listed, F.array().cast("array<string>"))))
    return F.filter(F.concat(*out), lambda p: p.isNotNull())


def rule_action(category: str, mode: str) -> str:
    return ("warn" if mode.lower() == "all_tools" else "block") if category == "privilege_escalation" else "block"


def _hit(rule: str, category: str, action: str, said: Column, kind: str) -> Column:
    sources = F.array(F.lit(f"heuristic:{kind}"), F.lit(f"rule:{rule}"))
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), F.lit(action).alias("action"), F.lit(1.0).cast("float").alias("confidence"), sources.alias("sources"), said.alias("evidence"))


def _cleaned(hits: Column) -> Column:
    """Hits with their evidence redacted and cut: one expression for all rules, not one each."""
    names = ("rule_id", "category", "action", "confidence", "sources")
    return F.transform(hits, lambda h: F.struct(*(h[n].alias(n) for n in names), evidence(h["evidence"]).alias("evidence")))


def shell_hits(command: Column, normal: Column, cfg: ToolGate) -> Column:
    """Every rule that the command hits, as written or normalized; the evidence is still raw."""
    hits = []
    for rule, category, pattern, exact in P.SHELL_RULES:
        full = rule_pattern(pattern, exact)
        found = F.when(first_match(command, full) != "", first_match(command, full)).when(first_match(normal, full) != "", first_match(normal, full)).otherwise(command)
        hits.append(F.when(matches(command, full) | matches(normal, full), _hit(rule, category, rule_action(category, cfg.mode), found, "tool_gate")))
    either = lambda pattern: matches(command, pattern) | matches(normal, pattern)
    hits.append(F.when(either(P.READ_VERBS) & either(P.SENSITIVE_PATHS), _hit("read_sensitive_files", "data_exfil", "block", command, "tool_gate")))
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def host_allowed(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a URL's host, with or without its port, is on the list."""
    wanted = [h.strip().lower() for h in hosts if h.strip()]
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    bare = F.when(host.startswith("["), F.regexp_replace(host, r"^\[(.*)\]:[^\]]*$", "$1")).otherwise(F.regexp_replace(host, r":[^:]*$", ""))
    return (host != "") & (host.isin(wanted) | bare.isin(wanted)) if wanted else F.lit(False)


def judge(calls: DataFrame, cfg: ToolGate, name: str = "name", kind: str = "type", args: str = "args") -> DataFrame:
    """``calls`` with ``action`` (block, warn or allow), ``hits`` and ``primary`` (the first
    blocking hit, else the first, else null).

    ``args`` is a JSON object. Bodies that aren't strings are judged by their JSON text.
    """
    empty = F.filter(F.array(_hit("", "", "", F.lit(""), "")), lambda h: F.lit(False))
    if not cfg.enabled:
        out = calls.withColumn("hits", empty)
    else:
        a = F.col(args)
        command = F.col("__command")
        normal = F.col("__normal")
        calls = calls.withColumn("__type", tool_type(F.col(name), F.col(kind), a)).withColumn("__command", shell_command(a)).withColumn("__normal", normalized_shell(command))
        allowed = F.lit(False)
        for entry in (c.strip() for c in cfg.commands if c.strip()):
            allowed = allowed | (F.trim(command) == entry) | (normal == entry)
        shell = F.when((F.trim(command) == "") | allowed, empty).otherwise(shell_hits(command, normal, cfg))
        read = F.lower(F.trim(F.col(name))) == "filesystem.read"
        bad = F.filter(path_arguments(a), lambda p: matches(p, P.SENSITIVE_PATHS))
        files = F.when(read & (F.size(bad) > 0), F.array(_hit("read_sensitive_files", "data_exfil", "block", F.element_at(bad, 1), "tool_gate"))).otherwise(empty)
        url, method = F.coalesce(_string_arg(a, "url"), F.lit("")), F.upper(F.trim(F.coalesce(_string_arg(a, "method"), F.lit(""))))
        body = F.coalesce(F.get_json_object(a, "$.body"), F.lit(""))
        large = (F.octet_length(body) > 4096) | ((body != "") & matches(body, P.BASE64_RUN))
        sends = (url != "") & method.isin("POST", "PUT", "PATCH") & ~host_allowed(url, cfg.hosts) & large
        http = F.when(sends, F.array(_hit("http_large_body_exfil", "data_exfil", "block", F.concat_ws(" ", method, url), "tool_gate"))).otherwise(empty)
        t = F.col("__type")
        found = F.when(t == "shell", shell).when(t == "filesystem", files).when(t == "http", http).otherwise(empty)
        out = calls.withColumn("hits", _cleaned(found)).drop("__type", "__command", "__normal")
    blocking = F.filter("hits", lambda h: h["action"] == "block")
    action = F.when(F.size(blocking) > 0, "block").when(F.exists("hits", lambda h: h["action"] == "warn"), "warn").otherwise("allow")
    return out.withColumns({"action": action, "primary": F.coalesce(F.try_element_at(blocking, F.lit(1)), F.try_element_at("hits", F.lit(1)))})


def execute(calls: DataFrame, cfg: ToolGate, key: str = "id", vendor: str = "acme", **columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a tool runner does with ``calls``: (hits, errors, allowed).

    Every hit is a row, also those that only warn; a blocked call gives an error
    row with its primary rule and isn't among the allowed ones, which are left as
    they came.
    """
    judged = judge(calls, cfg, **columns)
    hits = judged.select(key, F.explode_outer("hits").alias("__hit")).where(F.col("__hit").isNotNull()).select(key, "__hit.*")
    blocked = judged.where(F.col("action") == "block")
    errors = blocked.select(key, F.lit(f"{vendor}_tool_policy_violation").alias("type"), F.lit("tool_blocked").alias("code"), F.col("primary.rule_id").alias("rule_id"), F.col("primary.category").alias("category"))
    return hits, errors, judged.where(F.col("action") != "block").select(*calls.columns)


def guard(df: DataFrame, cfg: Guard, text: str = "text") -> DataFrame:
    """The same rules over model output: adds ``decision`` (allow or warn), ``note`` and
    ``guard_hits``. It never blocks; the text is taken as it is, and dots cross lines."""
    own = F.coalesce(F.col(text), F.lit(""))
    hits = []
    if cfg.enabled and cfg.mode.strip().lower() != "ignore":
        for rule, category, pattern, exact in P.SHELL_RULES:
            instruction = INSTRUCTIONS[category]
            if cfg.action(instruction) != "ignore":
                full = rule_pattern(pattern, exact, dot_all=True)
                hits.append(F.when(matches(own, full), _hit(rule, instruction, cfg.action(instruction), first_match(own, full), "response_guard")))
        instruction = INSTRUCTIONS["data_exfil"]
        if cfg.action(instruction) != "ignore":
            hits.append(F.when(matches(own, P.READ_VERBS) & matches(own, P.SENSITIVE_PATHS), _hit("read_sensitive_files", instruction, cfg.action(instruction), own, "response_guard")))
    found = F.filter(F.array(*hits), lambda h: h.isNotNull()) if hits else F.filter(F.array(_hit("", "", "", F.lit(""), "")), lambda h: F.lit(False))
    df = df.withColumn("guard_hits", _cleaned(found))
    warned = F.exists("guard_hits", lambda h: h["action"] == "warn")
    return df.withColumns({"decision": F.when(warned, "warn").otherwise("allow"), "note": F.when(warned, "unsafe_instruction_detected").otherwise("")})
