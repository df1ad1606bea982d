"""Redaction: input categories, output, entity spans, log lines, URLs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardframe.functions import patterns as P
from guardframe.functions.dialect import java_pattern
from guardframe.functions.strings import matches, replaced
from guardframe.operators.detect import Entities, banned_terms, label_hits

#: Redaction of personal data, in order: pattern, placeholder, toggle. The order
#: matters: a phone number swallows a card number, and a placeholder can look like a token.
STEPS = (
    (P.EMAIL, "[REDACTED_EMAIL]", "email"),
    (P.PHONE, "[REDACTED_PHONE]", "phone"),
    (P.CREDIT_CARD, "[REDACTED_CREDIT_CARD]", "credit_card"),
    (P.IBAN, "[REDACTED_IBAN]", "iban"),
    (P.TOKEN, "[REDACTED_TOKEN]", "tokens"),
)


def pii(text: Column, entities: Entities = Entities(), found: Column | None = None) -> Column:
    """Personal data replaced. ``found``, if known, says whether there is any; texts without are left as they are."""
    out = text
    for pattern, placeholder, toggle in STEPS:
        if getattr(entities, toggle):
            out = replaced(out, pattern, placeholder)
    if found is None:
        found = F.lit(False)
        for hit in label_hits(text, entities).values():
            found = found | hit
    return F.when(found, out).otherwise(text)


def secrets(text: Column, entities: Entities = Entities()) -> Column:
    return replaced(text, P.TOKEN, "[REDACTED_TOKEN]") if entities.tokens else text


def banned(text: Column, words: Iterable[str]) -> Column:
    for term in banned_terms(words):
        text = replaced(text, "(?i)" + re.sub(r"([^\w\s])", r"\\\1", term), "[REDACTED_BANNED]")
    return text


def by_category(text: Column, category: str, entities: Entities = Entities(), words: Iterable[str] = ()) -> Column:
    """Redaction for a category that was hit; categories without one leave the text alone."""
    if category == "banned_words":
        return banned(text, words)
    if category == "pii":
        return pii(text, entities, found=F.lit(True))
    return secrets(text, entities) if category == "secrets" else text


def output(text: Column) -> Column:
    return F.when(matches(text, P.OUTPUT_REDACTION), replaced(text, P.OUTPUT_REDACTION, "[REDACTED]")).otherwise(text)


def preview(text: Column) -> Column:
    """The simple redactor of previews: addresses, then tokens."""
    return replaced(replaced(text, P.PREVIEW_EMAIL, "[REDACTED_EMAIL]"), P.TOKEN, "[REDACTED_TOKEN]")


def placeholder(kind: Column) -> Column:
    """What stands for an entity of a kind."""
    low = F.lower(kind)
    return (
        F.when(low.contains("email"), "[REDACTED_EMAIL]")
        .when(low.contains("phone"), "[REDACTED_PHONE]")
        .when(low.contains("credit"), "[REDACTED_CREDIT_CARD]")
        .when(low.contains("iban"), "[REDACTED_IBAN]")
        .when(low.contains("token") | low.contains("secret") | low.contains("key"), "[REDACTED_TOKEN]")
        .otherwise("[REDACTED]")
    )


def spans(text: Column, entities: Column) -> Column:
    """The text with byte spans (start_byte, end_byte, entity_type) replaced.

    Spans outside the text or empty are dropped; of overlapping ones the first
    by (start, end) counts.
    """
    data, size = text.cast("binary"), F.octet_length(text)
    valid = F.filter(entities, lambda e: (e["start_byte"] >= 0) & (e["end_byte"] > e["start_byte"]) & (e["end_byte"] <= size))
    ordered = F.array_sort(F.transform(valid, lambda e: F.struct(e["start_byte"].cast("int").alias("s"), e["end_byte"].cast("int").alias("e"), e["entity_type"].alias("k"))))
    part = lambda start, length: F.substring(data, start, length).cast("string")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("said"))
    step = lambda acc, x: F.when(x["s"] < acc["at"], acc).otherwise(
        F.struct(x["e"].alias("at"), F.concat(acc["said"], part(acc["at"] + 1, x["s"] - acc["at"]), placeholder(x["k"])).alias("said"))
    )
    return F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["said"], part(acc["at"] + 1, size - acc["at"])))


def url(raw: Column) -> Column:
    """scheme://host/last-segment, without query and user; a placeholder for the path if it ends in a slash."""
    parts = lambda k: F.regexp_extract(raw, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)", k)
    scheme, host, path = F.lower(parts(1)), parts(2), F.regexp_replace(parts(3), r"/\z", "")
    last = F.regexp_extract(path, r"(?s)([^/]*)/*\z", 1)
    where = F.concat(scheme, F.lit("://"), host)
    hidden = F.concat(where, F.lit("/[REDACTED_PATH]"))
    return (
        F.when((scheme == "") | (host == ""), "[REDACTED_URL]").when(raw.endswith("/") | (last == "") | (last == "."), hidden).otherwise(F.concat(where, F.lit("/"), last))
    )


def urls_in(text: Column) -> Column:
    """Every URL of a text redacted: the pieces between them are joined with the redacted URLs."""
    pattern = java_pattern(P.URL)
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(between, F.transform(found, url), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(matches(text, P.URL), F.array_join(pieces, "")).otherwise(text)


def log_line(text: Column, vendor: str = "acme") -> Column:
    """Known secret patterns of a log line, in a fixed order; ``vendor`` prefixes licence keys and a key header."""
    out = replaced(text, P.AUTH_HEADER, r"\1[REDACTED]")
    out = replaced(out, P.BEARER, r"\1[REDACTED]")
    out = replaced(out, P.API_KEY_LIST, r"\1REDACTED\3")
    out = replaced(out, P.API_KEY_VALUE, r"\1[REDACTED]")
    out = replaced(out, rf"(?i){vendor}-[A-Za-z0-9-]+", f"{vendor.upper()}-[REDACTED]")
    # Callbacks that leave some matches alone are look-aheads here.
    out = F.regexp_replace(out, java_pattern(P.LICENSE_FIELD).replace(r"([^\t\n\f\r ]+)", r"(?![^\t\n\f\r ]*(?-iu:REDACTED))([^\t\n\f\r ]+)"), "$1[REDACTED]")
    out = replaced(out, P.PROVIDER_KEY, r"\1[REDACTED]")
    out = replaced(out, rf"(?i)({'|'.join(P.HEADER_KEY_NAMES)}|x-{vendor}-key){P.VALUE}", r"\1[REDACTED]")
    out = replaced(out, P.TOKENISH, r"\1=[REDACTED]")
    return F.regexp_replace(urls_in(out), r"(\[REDACTED\]){2,}", "[REDACTED]")
