"""The activation event: derived finals, notes, previews, categories, latencies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardframe.functions.strings import cut_bytes, random_id, rfc3339
from guardframe.operators import redact
from guardframe.operators.policy import keep_first

#: Words that no attribute's key may hold.
DENY_WORDS = ("prompt", "content", "authorization", "api_key", "token", "email", "phone", "iban", "credit_card")
UNSAFE_NOTE = "unsafe_instruction_detected"


def _influences(action: Column) -> Column:
    low = F.lower(F.trim(action))
    return low.contains("block") | low.contains("redact") | low.contains("warn")


def request_final(decision: Column, hits: Column) -> Column:
    """block, allow (also for any provider error) or redact."""
    redacts = F.exists(hits, lambda h: F.lower(h["action"]).contains("redact"))
    return F.when(decision == "blocked_before", "block").when(decision == "error_provider", "allow").when(redacts, "redact").otherwise("allow")


def response_final(decision: Column, mode: Column, post: Column, checked: Column, note: Column) -> Column:
    """(final, note) of the response; ``checked`` tells whether a post-check ran."""
    said = F.coalesce(note, F.lit(""))
    result = lambda final, n: F.struct((F.lit(final) if isinstance(final, str) else final).alias("final"), n.alias("note"))
    none = F.lit(None).cast("string")
    given = F.when(said == UNSAFE_NOTE, "warn").otherwise("allow")
    return (
        F.when(decision.isin("blocked_before", "blocked_after", "error_provider"), result("block", F.when(said != "", said)))
        .when((F.lower(F.trim(post)) == "redacted") & (mode == "stream"), result("allow", F.lit("redaction_suggested")))
        .when(F.lower(F.trim(post)) == "redacted", result("redact", F.lit("redaction_applied")))
        .when(said != "", result(given, said))
        .otherwise(result("allow", F.when(~checked, "skipped").otherwise(none)))
    )


def reason_categories(hits: Column) -> Column:
    """Distinct categories whose action blocks, redacts or warns, sorted."""
    kept = F.filter(hits, lambda h: _influences(h["action"]) & (F.trim(h["category"]) != ""))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda h: F.trim(h["category"]))))


def category_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.filter(F.array_union(a, b), lambda c: c != ""))


def preview(text: Column, level: str) -> Column:
    """A message's preview: at most 500 bytes, then cleaned like a log line; empty at level metadata."""
    if level == "full":
        return redact.log_line(cut_bytes(text, 500, "…"))
    return redact.log_line(cut_bytes(redact.preview(text), 500, "…")) if level == "redacted" else F.lit("")


def total_latency(pre: Column, provider: Column, post: Column) -> Column:
    none = F.lit(0.0)
    return F.coalesce(pre, none) + F.coalesce(provider, none) + F.coalesce(post, none)


def post_checked(latency: Column, hits: Column, scores: Column) -> Column:
    """Whether a post-check ran: it took time, or it left hits or scores."""
    return (F.coalesce(latency, F.lit(0.0)) > 0) | F.coalesce(F.size(hits) > 0, F.lit(False)) | F.coalesce(F.size(scores) > 0, F.lit(False))


def guard_scores(hits: Column) -> Column:
    """Scores that the response guard's hits give: 1 for an instruction that carries data off."""
    exfil = "data_exfil_instruction"
    return F.when(F.exists(hits, lambda h: h["category"] == exfil), F.create_map(F.lit(exfil), F.lit(1.0).cast("float")))


def thresholds(cfg) -> dict[str, dict[str, float]]:
    """The thresholds that are set, by category."""
    out = {}
    for name in ("prompt_injection", "jailbreak", "data_exfil", "pii", "secrets"):
        section = getattr(cfg, name)
        found = {level: getattr(section, level) for level in ("warn", "block") if getattr(section, level) > 0}
        if found:
            out[name] = found
    return out


@dataclass(frozen=True)
class Engine:
    """What is known of the detection engine; the model's part is left out of events if it is empty."""

    status: str = ""
    bundle_version: str = ""
    last_validated_at: str = ""
    cache_present: bool = False
    model_status: str = ""
    model_version: str = ""
    model: str = ""
    included: bool = False
    thresholds: dict[str, dict[str, float]] = field(default_factory=dict)
    default_model: str = "guard_v1"


def engine_info(engine: Engine) -> Column:
    """The event's block about the engine; empty texts are null."""
    said = lambda x: F.lit(x or None).cast("string")
    model = F.struct(F.lit(engine.model_status).alias("status"), F.lit(engine.model_version).alias("bundle_version"), F.lit(engine.model.strip() or engine.default_model).alias("model"))
    shown = engine.included or bool(engine.model_status or engine.model_version)
    limit = lambda t, level: F.lit(t.get(level)).cast("float").alias(level)
    limits = [x for name, t in sorted(engine.thresholds.items()) for x in (F.lit(name), F.struct(limit(t, "warn"), limit(t, "block")))]
    none = F.lit(None).cast("map<string,struct<warn:float,block:float>>")
    return F.struct(
        F.lit(engine.status).alias("status"),
        said(engine.bundle_version).alias("bundle_version"),
        said(engine.last_validated_at).alias("last_validated_at"),
        F.lit(engine.cache_present).alias("cache_present"),
        (model if shown else F.lit(None).cast("struct<status:string,bundle_version:string,model:string>")).alias("model_engine"),
        (F.create_map(*limits) if limits else none).alias("thresholds"),
    )


_ENTRY = "array<struct<category:string,action:string,confidence:float,sources:array<string>,evidence:string>>"


def entries(hits: Column, evidence: bool) -> Column:
    """Hits as an event shows them: a zero confidence and empty sources are null, rule ids are left out."""
    entry = lambda h: F.struct(
        h["category"].alias("category"),
        h["action"].alias("action"),
        F.when(h["confidence"] != 0, h["confidence"]).alias("confidence"),
        F.when(F.size(h["sources"]) > 0, h["sources"]).alias("sources"),
        (F.when(h["evidence"] != "", h["evidence"]) if evidence else F.lit(None).cast("string")).alias("evidence"),
    )
    return F.transform(hits, entry).cast(_ENTRY)


def events(df: DataFrame, mode: str = "non_stream", level: str = "redacted", engine: Engine = Engine(), now: Column | None = None) -> DataFrame:
    """One nested event per request.

    Input columns: request_id, project_id, provider, model, prompt, output,
    blocked, decisions (category, action, confidence, sources), post_decision,
    note, guard_hits; optional: error (the provider failed), scores and
    post_scores (maps), pre_ms, provider_ms, post_ms, check_ms. Of the guard's
    hits the first of each category counts. A missing request id becomes a random
    one. Empty arrays, maps and texts are null, so ``to_json`` leaves them out.
    """
    mode = (mode or "").strip().lower() or "non_stream"
    has = lambda name, kind: F.col(name) if name in df.columns else F.lit(None).cast(kind)
    millis = lambda name: F.coalesce(has(name, "double"), F.lit(0.0))
    filled = lambda a: F.when(F.size(a) > 0, a)
    kept = keep_first(F.col("guard_hits"), ignore_case=True)
    df = df.withColumns({"__request": entries(F.col("decisions"), False), "__response": entries(kept, True)})
    scores = F.map_concat(*(F.coalesce(x, F.create_map().cast("map<string,float>")) for x in (guard_scores(F.col("guard_hits")), has("post_scores", "map<string,float>"))))
    df = df.withColumns({"__scores": scores, "__post_ms": millis("post_ms") + millis("check_ms")})
    decision = F.when(F.col("blocked"), "blocked_before").when(F.coalesce(has("error", "boolean"), F.lit(False)), "error_provider").otherwise("allow")
    checked = post_checked(F.col("__post_ms"), F.col("__response"), F.col("__scores"))
    df = df.withColumns({"__request_final": request_final(decision, F.col("__request")), "__response_final": response_final(decision, F.lit(mode), F.col("post_decision"), checked, F.col("note"))})
    df = df.withColumns({"__request_reasons": reason_categories(F.col("__request")), "__response_reasons": reason_categories(F.col("__response"))})

    def side(name: str, final: Column, note: tuple, key: str, text: str, scores: Column, latency: Column) -> Column:
        hits = filled(F.col(f"__{name}"))
        return F.struct(
            F.struct(final.alias("final"), *note, filled(F.col(f"__{name}_reasons")).alias("reason_categories"), hits.alias("actions")).alias("decision"),
            F.struct(preview(F.col(text), level).alias(key)).alias("preview"),
            hits.alias("hits"),
            filled(scores).alias("scores"),
            latency.alias("latency_ms"),
        )

    final, note = F.col("__response_final")["final"], F.col("__response_final")["note"]
    return df.select(
        F.lit("2").alias("version"),
        (F.current_timestamp() if now is None else now).alias("timestamp"),
        F.coalesce(F.when(F.col("request_id") != "", F.col("request_id")), random_id()).alias("request_id"),
        F.struct("project_id", F.col("provider").alias("provider_id"), "provider", "model", F.lit(mode).alias("mode")).alias("meta"),
        F.struct(
            F.col("__request_final").alias("request_final"),
            final.alias("response_final"),
            note.alias("response_note"),
            (F.col("__request_final") == "block").alias("blocked"),
            filled(category_union(F.col("__request_reasons"), F.col("__response_reasons"))).alias("categories"),
        ).alias("summary"),
        side("request", F.col("__request_final"), (), "prompt", "prompt", has("scores", "map<string,float>"), millis("pre_ms")).alias("request"),
        side("response", final, (note.alias("note"),), "output", "output", F.col("__scores"), F.col("__post_ms")).alias("response"),
        engine_info(engine).alias("intel"),
        F.struct(millis("provider_ms").alias("provider"), total_latency(millis("pre_ms"), millis("provider_ms"), F.col("__post_ms")).alias("total")).alias("timing_ms"),
    )


def event_line(events: DataFrame, vendor: str = "acme") -> Column:
    """The event as one redacted JSON line, as it is logged and sent in a response header.

    Times are RFC 3339 in UTC."""
    return redact.log_line(F.to_json(F.struct(*(rfc3339(F.col(c)).alias(c) if t == "timestamp" else F.col(c) for c, t in events.dtypes))), vendor)


def fallback(has_key: Column, result: Column, version: Column) -> Column:
    """(cache allowed, status, reason) after a failed licence validation."""
    out = lambda cache, status, reason: F.struct(F.lit(cache).alias("cache"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    filled = F.trim(F.coalesce(version, F.lit(""))) != ""
    return (
        F.when(~has_key, out(False, "disabled_missing_license", "missing_license"))
        .when(result == "invalid_license", out(False, "disabled_invalid_license", "invalid_license"))
        .when((result == "network_error") & filled, out(True, "offline_cached_bundle", "network_error"))
        .when(result == "network_error", out(False, "disabled_missing_bundle", "missing_bundle"))
        .otherwise(out(False, "disabled_invalid_bundle", "invalid_bundle"))
    )


def bundle_fallback(verified: Column, version: Column, require_ml: Column, regex_only: Column) -> Column:
    """How to go on after a bundle update: ml, regex_only, error or disabled_ml."""
    keep = verified | (F.trim(F.coalesce(version, F.lit(""))) != "")
    return F.when(keep, "ml").when(regex_only, "regex_only").when(require_ml, "error").otherwise("disabled_ml")


def licence_outcome(status: Column) -> Column:
    """The outcome of a validation call by its HTTP status; null on success."""
    return F.when(status.isin(401, 403), "invalid_license").when(status >= 500, "network_error").when((status < 200) | (status >= 300), "other_error")


def safe_attributes(attributes: Column, most_bytes: int = 512) -> Column:
    """A string map without keys that hold a deny word and without values over ``most_bytes``."""
    words = DENY_WORDS
    bad = lambda k: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(k), w))
    return F.map_filter(attributes, lambda k, v: ~bad(k) & (F.octet_length(v) <= most_bytes))


def private_host(authority: Column) -> Column:
    """Whether a host, with or without a port, is local or an address in a private range."""
    low = F.lower(F.trim(authority))
    host = F.when(low.startswith("["), F.regexp_extract(low, r"^\[([^\]]*)\]", 1)).when(F.regexp_count(low, F.lit(":")) == 1, F.substring_index(low, ":", 1)).otherwise(low)
    # An IPv4 address within an IPv6 one, in either notation.
    host = F.regexp_replace(host, r"^(?:::|(?:0+:){5})ffff:(?=\d+\.)", "")
    word = lambda k: F.conv(F.regexp_extract(host, r"^(?:::|(?:0+:){5})ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", k), 16, 10).try_cast("int")
    high = F.when(host.rlike(r"^(?:::|(?:0+:){5})ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), word(1))
    octet = lambda k: F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}$", k).try_cast("int")
    a, b = F.coalesce(octet(1), F.shiftright(high, 8)), F.coalesce(octet(2), high.bitwiseAND(255))
    four = a.isin(10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
    six = host.rlike(r"^(::1|(0+:){7}0*1|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$")
    return (host == "localhost") | F.coalesce(four, F.lit(False)) | six
