"""String operators on Columns, and the same in the SQL of the oracle."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardframe.functions.dialect import java_pattern, sql_text


def matches(text: Column, pattern: str) -> Column:
    """Whether an RE2 pattern is found in the text.

    Word boundaries cost a look-around at every place, so the pattern without
    them, which finds all that it finds and perhaps more, is asked first.
    """
    exact, loose = java_pattern(pattern), re.sub(r"(\\[^b])|\\b", r"\1", pattern)
    return text.rlike(exact) if loose == pattern else text.rlike(java_pattern(loose)) & text.rlike(exact)


def replaced(text: Column, pattern: str, replacement: str) -> Column:
    r"""All matches replaced; groups in the replacement are written as \1."""
    java = replacement.replace("$", r"\$").replace("\\1", "$1").replace("\\3", "$3")
    return F.regexp_replace(text, F.lit(java_pattern(pattern)), F.lit(java))


def first_match(text: Column, pattern: str) -> Column:
    """The first match, empty if there is none."""
    return F.regexp_extract(text, java_pattern(pattern), 0)


def cut_bytes(text: Column, most: int, ellipsis: str = "") -> Column:
    """At most so many bytes; a character cut in two becomes U+FFFD."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut, F.lit(ellipsis)))


def rfc3339(time: Column) -> Column:
    """A point in time as RFC 3339 text in UTC, to the microsecond, without trailing zeros."""
    utc = F.to_utc_timestamp(time, F.current_timezone())
    parts = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(parts, r"\.?0*$", ""), F.lit("Z"))


def millis(nanoseconds: Column) -> Column:
    """A duration in nanoseconds as milliseconds."""
    return nanoseconds.cast("double") / 1e6


def millis_of_whole_micros(nanoseconds: Column) -> Column:
    """The same, cut to whole microseconds first."""
    return F.floor(nanoseconds / 1000).cast("double") / 1e3


def short_hash(text: Column) -> Column:
    """The first eight hex digits of a trimmed text's SHA-256; empty for an empty text."""
    own = F.trim(F.coalesce(text, F.lit("")))
    return F.when(own == "", "").otherwise(F.substring(F.sha2(own, 256), 1, 8))


def random_id() -> Column:
    """128 random bits in hex."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def sql_matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {sql_text(pattern)})"


def sql_replaced(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {sql_text(pattern)}, {sql_text(replacement)}, 'g')"
