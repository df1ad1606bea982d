"""Secret scans by multipart credential linking.

Three base patterns report spans of their own. Beside them the scan collects
weak parts that mean little alone: unlabelled key material and endpoints. An
interval join inside a document pairs them: parts are sorted by place, and a
weak part is reported only if complementary parts lie in the same scope. A scope
ends at a blank line, unless the lines beside it are settings (a name, then = or
:) or comments, so that the parts of a configuration are joined across its blank
lines, however far apart.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardframe.llm.common import released, slices

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "material", "endpoint")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_MATERIAL = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{36,}={0,2}(?![A-Za-z0-9+/=_-])")
#: Further access identifiers, which link weak parts but aren't reported: other prefixes of the same maker, and named ones.
_IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:ASIA|AROA|AIDA|LTAI|AKID)[A-Za-z0-9]{12,}|(?ai:access_?key_?id|client_?id|account_?(?:name|id)|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""")
_ENDPOINT = re.compile(r"""(?ai:https?|wss?|amqps?|postgres(?:ql)?|mysql|redis|mongodb)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+""")
_BLANK_LINES = re.compile(r"\n(?:[\x20\t\r]*+\n)++")
_SETTING = re.compile(r"""[\x20\t]*+(?:[#;]|//|(?:export\x20+)?["']?[A-Za-z_][A-Za-z0-9_.-]*+["']?[\x20\t]*+[:=])""")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans (start, kind's place in KINDS, end) of the base patterns."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


def _mixed(word: str) -> bool:
    """Key material has capitals, small letters and digits; prose and hex haven't all."""
    return any(c.isupper() for c in word) and any(c.islower() for c in word) and any(c.isdigit() for c in word)


def weak_spans(text: str) -> list[Span]:
    found = [(m.start(), 3, m.end()) for m in _MATERIAL.finditer(text) if _mixed(m.group())]
    found += [(m.start(), 4, m.end()) for m in _ENDPOINT.finditer(text)] if "://" in text else []
    return found


def scope_ends(text: str) -> list[int]:
    """Where the scopes of a text end: at the blank lines that don't stand between settings."""
    ends = []
    for m in _BLANK_LINES.finditer(text):
        before = text.rfind("\n", 0, m.start()) + 1
        if not (_SETTING.match(text, before, m.start()) and _SETTING.match(text, m.end())):
            ends.append(m.start())
    return ends


def _near(starts: list[int], spans: list[Span], scope: tuple[int, int]) -> bool:
    """Whether one of the spans, sorted by start, lies in the scope.

    No span is longer than the distance to the next one's start of its own kind,
    so the last that starts before the window is the only one that can reach into it.
    """
    low, high = scope
    at = bisect_left(starts, low)
    if at < bisect_right(starts, high):
        return True
    return at > 0 and spans[at - 1][2] > low and spans[at - 1][0] >= scope[0]


def _outermost(spans: list[Span]) -> list[Span]:
    """Spans by start, without those that end within one before."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[2])):
        if not out or s[2] > out[-1][2]:
            out.append(s)
    return out


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts with complementary parts in their scope.

    Material needs an access identifier or an endpoint; an endpoint needs both
    an identifier and a secret (an assignment, hex or such material).
    """
    weak = weak_spans(text)
    if not weak:
        return []
    by_kind = {k: sorted(s for s in [*base, *weak] if s[1] == k) for k in range(len(KINDS))}
    taken = {(s[0], s[2]) for s in base}
    solid = {k: (v, [s[0] for s in v]) for k, v in by_kind.items() if k < len(BASE_KINDS)}
    by_kind[1] = _outermost([*by_kind[1], *((m.start(), 1, m.end()) for m in _IDENTIFIER.finditer(text))])
    starts = {k: [s[0] for s in v] for k, v in by_kind.items()}
    ends = [0, *scope_ends(text), len(text)]
    known: dict[tuple[int, tuple[int, int]], bool] = {}

    def near(kind: int, scope: tuple[int, int]) -> bool:
        if (kind, scope) not in known:
            known[kind, scope] = _near(starts[kind], by_kind[kind], scope)
        return known[kind, scope]

    found = []
    for span in weak:
        at = max(1, bisect_right(ends, span[0]))
        scope = (ends[at - 1], ends[at] if at < len(ends) else len(text))
        if span[1] == 3:
            inside = any(s <= span[0] and span[2] <= e for own, at in solid.values() for s, _, e in own[max(0, bisect_right(at, span[0]) - 1) : bisect_right(at, span[0])])
            if not inside and (near(1, scope) or near(4, scope)):
                found.append(span)
        elif near(1, scope) and any(near(k, scope) for k in (0, 2, 3)):
            found.append(span)
    return [s for s in found if (s[0], s[2]) not in taken]


def scan_text(text: str | None) -> list[Span]:
    """All spans of a text, by start and then kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + linked_spans(text, base))


def masked(text: str | None, spans: list[Span], mask: str) -> str | None:
    """The text with every covered stretch replaced; overlapping spans are one stretch."""
    if not spans:
        return text
    runs: list[list[int]] = []
    for start, _, end in spans:
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    kept = [text[: runs[0][0]], *(text[a[1] : b[0]] for a, b in pairwise(runs)), text[runs[-1][1] :]]
    return mask.join(kept)


def scan(docs: DataFrame, text: str = "text", mask: str | None = None) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end) in code points, end
    exclusive, by start and then kind in the order of KINDS. With ``mask``, the
    spans in the text column are also replaced by it.

    Narrow: one pass, no shuffle, nothing kept between rows. A null or empty text
    has no spans; repeated rows each give a row; other columns pass through, but
    for one called ``spans``, which is replaced.
    """
    kept = docs.drop("spans")
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*kept.schema.fields, T.StructField("spans", T.ArrayType(span))])
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(text).to_pylist()
            spans = [scan_text(t) for t in texts]
            said = pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in one] for one in spans], arrow_span)
            columns = {name: batch.column(name) for name in batch.schema.names}
            if mask is not None:
                columns[text] = pa.array([masked(t, s, mask) for t, s in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values(), said], names=[*columns, "spans"])

    return kept.mapInArrow(released(run), schema)


def joined(spans: str, only: tuple[str, ...] | None = None):
    """Column: kind:start:end of the spans, comma-joined."""
    column = F.col(spans) if only is None else F.filter(spans, lambda s: s["kind"].isin(*only))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
