"""RE2 patterns for the JVM's regex engine.

Detection rules are written in RE2 syntax. ``java_pattern`` gives the pattern
that matches the same strings in ``java.util.regex``: ASCII word boundaries,
RE2's white space, ``$`` as the very end, ``.`` and line anchors that know only
the line feed, and Unicode case folding.
"""

from __future__ import annotations

import re

_SPACE = r"\t\n\f\r "
_BOUNDARY = "(?-iu:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
_NO_BOUNDARY = "(?-iu:(?<![0-9A-Za-z_])(?![0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_FLAGS = re.compile(r"\(\?([a-z]+)(\)|:)")


def java_pattern(pattern: str) -> str:
    """The equivalent Java pattern. Backreferences and look-around aren't RE2."""
    out, i, inside = ["(?d)"], 0, False
    lines = any("m" in flags for flags, _ in _FLAGS.findall(pattern))
    while i < len(pattern):
        c = pattern[i]
        pair = pattern[i : i + 2]
        if c == "\\":
            if pair == r"\s":
                out.append(_SPACE if inside else f"[{_SPACE}]")
            elif pair == r"\S":
                if inside:
                    raise ValueError(r"\S inside a class has no translation")
                out.append(f"[^{_SPACE}]")
            elif pair == r"\b":
                out.append(_BOUNDARY)
            elif pair == r"\B":
                out.append(_NO_BOUNDARY)
            else:
                out.append(pair)
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
                out.append(c)
            else:
                out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            inside = True
            start = pattern[i + 1 : i + 3]
            if start.startswith("^]"):
                out.append(r"[^\]")
                i += 3
                continue
            if start.startswith("]"):
                out.append(r"[\]")
                i += 2
                continue
            if start.startswith("^"):
                out.append("[^")
                i += 2
                continue
            out.append(c)
        elif c == "$" and not lines:
            out.append(r"\z")
        elif c == "(" and (m := _FLAGS.match(pattern, i)):
            flags = m.group(1).replace("i", "iu")
            out.append(f"(?{flags}{m.group(2)}")
            i = m.end()
            continue
        else:
            out.append(c)
        i += 1
    return "".join(out)


def sql_text(value: str) -> str:
    """A string literal of standard SQL."""
    return "'" + value.replace("'", "''") + "'"
