"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from guardframe.llm import queries_pairs, queries_text

ORACLES: dict[str, str] = {}


def queries() -> dict:
    found = {}
    for module in (queries_text, queries_pairs):
        found |= {name: f for name, f in vars(module).items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
