"""Merging signals into decisions, and applying them to requests and responses.

Decisions are arrays of structs computed within the row: a request never leaves
its task between detection and the final text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardframe.operators import detect, redact
from guardframe.plans.config import Category, Legacy, Security, parse_action

#: Name of the source that scores all categories at once.
ML_V1 = "ml_v1"
_HIT = "struct<category:string,action:string,confidence:float,sources:array<string>>"


def is_ml(source: Column) -> Column:
    return (source == ML_V1) | source.startswith("ml:")


def is_ner(source: Column) -> Column:
    return source.startswith("ner:")


def _evidence(signals: Column, regex: Callable, ml: Callable) -> tuple[Column, Column, Column]:
    """Whether a regex signal counts, the greatest model confidence, and the distinct sources in order."""
    ours = F.filter(signals, lambda s: regex(s) | ml(s))
    regex_hit = F.exists(signals, regex)
    confidence = F.coalesce(F.array_max(F.transform(F.filter(signals, ml), lambda s: s["confidence"])), F.lit(0.0).cast("float"))
    confidence = F.greatest(confidence, F.lit(0.0).cast("float"))
    return regex_hit, confidence, F.array_distinct(F.transform(ours, lambda s: s["source"]))


def _at_least(confidence: Column, threshold: float) -> Column:
    """Single-precision comparison; a threshold of zero is unset."""
    return (confidence >= F.lit(threshold).cast("float")) if threshold > 0 else F.lit(False)


def _hit(category: str, action: str, confidence: Column, sources: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(action).alias("action"), confidence.cast("float").alias("confidence"), sources.alias("sources"))


def threat_hit(category: str, signals: Column, cfg: Category) -> Column:
    """Decision of a threat category: a regex hit, then the block and warn thresholds; null without one."""
    names = [category] + (["data_exfil_attempt"] if category == "data_exfil" else [])
    regex = lambda s: s["category"].isin(names) & (s["source"] == "regex") & F.lit(cfg.regex_enabled)
    ml = lambda s: s["category"].isin(names) & is_ml(s["source"]) & F.lit(cfg.ml_enabled)
    found, confidence, sources = _evidence(signals, regex, ml)
    on_regex = cfg.on_regex or cfg.on_block
    out = F.when(found & F.lit(bool(on_regex)), _hit(category, on_regex, F.lit(1.0), sources))
    if cfg.ml_enabled:
        out = out.when(_at_least(confidence, cfg.block), _hit(category, cfg.on_block, confidence, sources))
        out = out.when(_at_least(confidence, cfg.warn), _hit(category, "warn", confidence, sources))
    return out


def pii_hit(signals: Column, cfg: Category) -> Column:
    regex = lambda s: s["category"].startswith("pii") & (s["source"] == "regex") & F.lit(cfg.regex_enabled)
    ml = lambda s: s["category"].isin("contains_personal_data", "pii") & (is_ml(s["source"]) | is_ner(s["source"])) & F.lit(cfg.ml_enabled)
    found, confidence, sources = _evidence(signals, regex, ml)
    out = F.when(found & F.lit(bool(cfg.on_regex)), _hit("pii", cfg.on_regex, F.lit(1.0), sources))
    return out.when(_at_least(confidence, cfg.warn), _hit("pii", cfg.on_ml, confidence, sources)) if cfg.ml_enabled else out


def secrets_hit(signals: Column, cfg: Category) -> Column:
    regex = lambda s: s["category"].startswith("secrets") & (s["source"] == "regex") & F.lit(cfg.regex_enabled)
    ml = lambda s: (s["category"] == "contains_secrets_maybe") & is_ml(s["source"]) & F.lit(cfg.ml_enabled)
    found, confidence, sources = _evidence(signals, regex, ml)
    out = F.when(found & F.lit(bool(cfg.on_regex)), _hit("secrets", cfg.on_regex, F.lit(1.0), sources))
    if cfg.ml_enabled:
        out = out.when(_at_least(confidence, cfg.block), _hit("secrets", cfg.on_regex, confidence, sources))
        out = out.when(_at_least(confidence, cfg.warn), _hit("secrets", cfg.on_ml, confidence, sources))
    return out


def merged_hits(signals: Column, cfg: Security) -> Column:
    """All categories' decisions in their fixed order."""
    hits = [threat_hit(c, signals, getattr(cfg, c)) for c in ("prompt_injection", "jailbreak", "data_exfil")]
    hits += [pii_hit(signals, cfg.pii), secrets_hit(signals, cfg.secrets)]
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def v1_signals(scores: Column, cfg: Security) -> Column:
    """Signals of the model that scores all labels: those at their warn threshold or above it."""
    labels = {"prompt_injection": cfg.prompt_injection, "jailbreak": cfg.jailbreak, "data_exfil_attempt": cfg.data_exfil, "contains_personal_data": cfg.pii, "contains_secrets_maybe": cfg.secrets}
    out = []
    for label, section in labels.items():
        score = F.element_at(scores, label)
        passed = score.isNotNull() if section.warn == 0 else score >= F.lit(section.warn).cast("float")
        out.append(F.when(passed, detect.signal(label, ML_V1, score)))
    return F.filter(F.array(*out), lambda s: s.isNotNull())


def specialist_signals(scores: Column) -> Column:
    """Signals of the single-purpose models; their scores aren't gated here."""
    sources = {"prompt_injection": "ml:prompt_injection", "jailbreak": "ml:jailbreak", "contains_personal_data": "ner:pii"}
    return F.filter(F.array(*(F.when(F.element_at(scores, label).isNotNull(), detect.signal(label, source, F.element_at(scores, label))) for label, source in sources.items())), lambda s: s.isNotNull())


def keep_first(hits: Column, ignore_case: bool = False) -> Column:
    """The first hit of each category."""
    name = lambda h: F.lower(h["category"]) if ignore_case else h["category"]
    step = lambda kept, h: F.when(F.exists(kept, lambda k: name(k) == name(h)), kept).otherwise(F.concat(kept, F.array(h)))
    return F.aggregate(hits, F.slice(hits, 1, 0), step)


def _acts(hit: Column, *names: str) -> Column:
    return F.lower(hit["action"]).isin(*names)


def _rewrites(category: str) -> Callable[[Column], Column]:
    """Whether a hit is of the category and rewrites the text."""
    return lambda h: (h["category"] == category) & ((h["action"] == "block_and_redact") | _acts(h, "redact"))


def before_model(df: DataFrame, security: Security, legacy: Legacy, text: str = "text", scores: str | None = None, entities: str | None = None) -> DataFrame:
    """The request check on each row's text.

    Adds ``decisions`` (hits), ``blocked``, ``block_reason`` (null if not
    blocked) and ``content`` (the text after all redactions). Detection runs once
    on the original text, redactions chain; blocking never stops the rest. A null
    text is an empty one.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    df, labels = detect.labelled(df, own, legacy.entities)
    hits = detect.categories(own, legacy.entities, legacy.words, labels)
    names = {name: f"__{name}" for name in hits}
    df = df.withColumns({names[name]: hit for name, hit in hits.items()} | {"__labels": detect.listed(labels)})
    flags = {name: F.col(column) for name, column in names.items()}
    content, reasons, decisions = own, [], F.array().cast(f"array<{_HIT}>")
    if security.enabled:
        signals = detect.regex_signals(F.col("__labels"), flags)
        if scores:
            signals = F.concat(signals, specialist_signals(F.col(scores)))
        # A column of its own: the merge refers to it many times.
        df = df.withColumn("__signals", signals).withColumn("__hits", merged_hits(F.col("__signals"), security))
        decisions = F.col("__hits")
        first = F.filter("__hits", lambda h: _acts(h, "block", "block_and_redact"))
        reasons.append(F.when(F.size(first) > 0, F.concat(F.lit("prompt blocked due to "), F.element_at(first, 1)["category"])))
        for category in ("pii", "secrets"):
            wanted = F.exists("__hits", _rewrites(category))
            changed = redact.by_category(content, category, legacy.entities)
            if category == "pii" and entities:
                changed = F.when(F.size(entities) > 0, redact.spans(content, F.col(entities))).otherwise(changed)
            df = df.withColumn(f"__content_{category}", F.when(wanted, changed).otherwise(content))
            content = F.col(f"__content_{category}")
    steps = [
        ("banned_words", "prompt blocked due to banned content"),
        ("injection", "prompt blocked or redacted due to possible injection"),
        ("pii", "prompt blocked or redacted due to PII/secrets"),
        ("prompt_injection", "prompt blocked or redacted due to possible prompt injection attempt"),
        ("jailbreak", "prompt blocked or redacted due to possible jailbreak attempt"),
        ("toxicity", "prompt blocked or redacted due to toxic or abusive language"),
    ]
    for category, reason in steps:
        if security.enabled and category in ("pii", "prompt_injection", "jailbreak"):
            continue
        action = parse_action(getattr(legacy, category), "log" if category == "toxicity" else "block")
        hit = _hit(category, action, F.lit(1.0), F.array(F.lit("regex")))
        decisions = F.concat(decisions, F.when(flags[category], F.array(hit)).otherwise(F.array().cast(f"array<{_HIT}>")))
        if action == "block":
            reasons.append(F.when(flags[category], F.lit(reason)))
        elif action == "redact":
            content = F.when(flags[category], redact.by_category(content, category, legacy.entities, legacy.words)).otherwise(content)
    reason = F.coalesce(*reasons, F.lit(None).cast("string"))
    out = df.withColumns({"decisions": keep_first(decisions), "block_reason": reason, "content": content})
    return out.withColumn("blocked", F.col("block_reason").isNotNull()).drop(*names.values(), *(c for c in df.columns if c.startswith("__label")), "__signals", "__hits", "__content_pii", "__content_secrets")


def after_model(df: DataFrame, text: str = "text") -> DataFrame:
    """Output redaction: adds ``output`` and ``post_decision`` (redacted or allow)."""
    own = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("output", redact.output(own))
    return df.withColumn("post_decision", F.when(F.col("output") != own, "redacted").otherwise("allow"))


def response_pii(df: DataFrame, cfg: Category, text: str = "text", entities: detect.Entities = detect.Entities(), scores: str | None = None, spans: str | None = None) -> DataFrame:
    """Personal data in a response: adds ``updated``, ``action`` (null without a hit) and ``changed``.

    Any personal-data label counts, tokens included. With model scores the regex
    isn't asked. A block turns into redact if something was redacted, else warn.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    if scores:
        score = F.element_at(F.col(scores), "contains_personal_data")
        signals = F.when(score.isNotNull(), F.array(detect.signal("contains_personal_data", "ner:pii", score))).otherwise(F.array().cast("array<struct<category:string,source:string,confidence:float,evidence:string>>"))
    else:
        found = detect.categories(own, entities)["pii"]
        signals = F.filter(F.array(F.when(found, detect.signal("pii", "regex", F.lit(1.0)))), lambda s: s.isNotNull())
    df = df.withColumn("__hit", F.when(F.trim(own) != "", pii_hit(signals, cfg)))
    action = F.lower(F.trim(F.col("__hit")["action"]))
    changed = redact.pii(own, entities)
    if spans:
        by_span = redact.spans(own, F.col(spans))
        changed = F.when((F.size(spans) > 0) & (by_span != own), by_span).otherwise(changed)
    df = df.withColumn("updated", F.when(action.isin("redact", "block", "block_and_redact"), changed).otherwise(own))
    df = df.withColumn("changed", F.col("updated") != own)
    return df.withColumn("action", F.when(action.isin("block", "block_and_redact"), F.when(F.col("changed"), "redact").otherwise("warn")).otherwise(F.col("__hit")["action"])).drop("__hit")


def system_prompt(messages: Column) -> Column:
    """System messages joined by line feeds; leading empty ones add none."""
    own = F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: F.coalesce(m["content"], F.lit("")))
    return F.aggregate(own, F.lit(""), lambda acc, x: F.when(acc == "", x).otherwise(F.concat(acc, F.lit("\n"), x)))
