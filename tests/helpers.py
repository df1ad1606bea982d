"""Comparison of result rows."""

from __future__ import annotations


def plain(value):
    """A value without its library's type; NaN and missing are None."""
    if value is None or value != value:
        return None
    kind = type(value).__name__
    if kind.startswith("bool"):
        return bool(value)
    return int(value) if "int" in kind else float(value) if "float" in kind else value


def bag(frame) -> list[str]:
    """A pandas frame's rows as sorted strings, columns by name."""
    return sorted(repr(tuple(plain(x) for x in row)) for row in frame[sorted(frame.columns)].itertuples(index=False))
