"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as entry


def test_queries_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    found = entry.entry(spark)
    assert {"doc_id", "labels", "redacted"} <= set(found.columns) and found.count() > 0
