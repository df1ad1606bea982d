"""The regex dialect's corner cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from guardframe.functions.dialect import java_pattern
from guardframe.functions.strings import cut_bytes

CASES = [
    (r"\btoken\b", "étoken", True),
    (r"a\sb", "a\x0bb", False),
    (r"a\sb", "a\tb", True),
    (r"a.b", "a\rb", True),
    (r"a.b", "a\nb", False),
    (r"(?s)a.b", "a\nb", True),
    (r"(?m)^b", "a\rb", False),
    (r"(?m)^b", "a\nb", True),
    (r"(?i)k", "K", True),
    (r"(?i)\bSKIP\b", "ſkip", False),
    (r"abc$", "abc\n", False),
    (r"abc$", "abc", True),
    (r"(?m)abc$", "abc\nd", True),
    (r"[[a]x", "[x", True),
    (r"[a&&b]x", "&x", True),
    (r"[]a]x", "]x", True),
    (r"[^]a]x", "]x", False),
    (r"[\s-]x", "-x", True),
]


@pytest.mark.parametrize("pattern, text, found", CASES)
def test_pattern_matches_as_in_re2(spark, duck, pattern, text, found):
    ours = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(java_pattern(pattern))).first()[0]
    assert ours is found
    if "&&" not in pattern:
        assert duck.execute("SELECT regexp_matches(?, ?)", [text, pattern]).fetchone()[0] is found


def test_byte_cut(spark):
    df = spark.createDataFrame([("aé",), ("ab",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(cut_bytes(F.col("t"), 2, "…")).collect()] == ["a�…", "ab", "ab…", None]
