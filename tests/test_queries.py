"""Every query with SQL gives the same rows in DuckDB; every other one runs."""

from __future__ import annotations

import math

import pytest

from guardframe.functions import patterns
from guardframe.functions.dialect import java_pattern
from guardframe.plans import events, queries  # noqa: F401  registering
from guardframe.plans.registry import ORACLES, QUERIES
from helpers import bag


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert bag(ours) == bag(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert len(QUERIES[name](spark, sf_dir).toPandas()) > 0


def test_spans_of_all_users_are_merged(spark, duck, tmp_path):
    """A hot user, and many others."""
    path = str(tmp_path / "events.parquet")
    duck.execute(f"COPY (SELECT i AS event_id, CASE WHEN i % 2 = 0 THEN 7 ELSE i % 90 END AS user_id, ['view', 'buy'][1 + i % 2] AS event_type, CAST(i * 37 % 1009 AS DOUBLE) / 3 AS value FROM range(4000) AS t(i)) TO '{path}' (FORMAT parquet)")
    ours = QUERIES["span_merge"](spark, str(tmp_path)).toPandas()
    sql = ORACLES["span_merge"].replace("FROM events", f"FROM '{path}'")
    assert bag(ours) == bag(duck.execute(sql).df()) and ours["user_id"].max() > 40


@pytest.mark.parametrize("name", ["scan_documents", "signals_long", "policy_regex", "before_model"])
def test_each_pattern_is_tested_once_a_row(spark, sf_dir, name):
    """The optimizer must not copy the detection into what refers to it."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    for pattern in ("EMAIL", "PHONE", "TOKEN", "SQL_INJECTION", "COMMAND_INJECTION", "PROMPT_INJECTION", "JAILBREAK"):
        java = java_pattern(getattr(patterns, pattern))
        assert plan.count(f"RLIKE {java}") + plan.count(f"rlike({java}") <= 1, pattern
    assert plan.count("RLIKE") <= 14  # those with word boundaries have two forms


def plain_word_piece(text, vocab, length=64):
    """Greedy longest pieces, word by word, until the row is full; then the tail."""
    ids = [vocab["[CLS]"]]
    for word in text.split():
        if len(ids) >= length - 1:
            break
        word, own, at = word.lower(), [], 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab), None)
            if end is None:
                own = [vocab["[UNK]"]]
                break
            own.append(vocab[("##" if at else "") + word[at:end]])
            at = end
        ids += own
    ids = [*ids, vocab["[SEP]"]]
    if len(ids) > length:
        ids = [vocab["[CLS]"], *ids[-length + 1 :]]
    return ids + [vocab["[PAD]"]] * (length - len(ids)), len(ids)


def plain_unigram(text, pieces, length=64):
    """The best of all segmentations, by recursion from the end of the text's bytes; the earlier of equals."""
    data = "▁".join(["", *text.split()]).encode() if text.split() else b""
    known = {p.encode(): (s, i) for i, (p, s) in enumerate(pieces)}
    best = [(0.0, [])]
    starts = [any(data.startswith(k, at) for k in known) for at in range(len(data))]
    for end in range(1, len(data) + 1):
        found = (-math.inf, None)
        for at in range(max(0, end - 40), end):
            if best[at][1] is None:
                continue
            step = known.get(data[at:end]) or ((pieces[0][1], 0) if end == at + 1 and not starts[at] else None)
            if step and best[at][0] + step[0] > found[0]:
                found = best[at][0] + step[0], [*best[at][1], step[1]]
        best.append(found)
    ids = [1, *(best[-1][1] or [])][:length]
    if len(ids) < length:
        ids.append(2)
    return ids + [0] * (length - len(ids)), len(ids)


@pytest.mark.parametrize("name", ["wordpiece", "unigram"])
def test_tokenizer_queries_by_brute_force(spark, duck, sf_dir, name):
    vocab = {p: i for i, p in enumerate(events.PIECES)}
    scored = list(dict([("<unk>", -10.0), ("<s>", 0.0), ("</s>", 0.0), *((p.replace("##", ""), -2.0 - len(p) / 10) for p in events.PIECES[4:]), ("▁", -3.0)]).items())
    texts = {(c, t): x for c, t, x in duck.execute("SELECT conv_id, turn, text FROM conversations").fetchall()}
    rows = QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == len(texts) and all(r["used"] <= 64 for r in rows)
    for r in rows:
        text = texts[r["conv_id"], r["turn"]] or ""
        ids, used = plain_word_piece(text, vocab) if name == "wordpiece" else plain_unigram(text, scored)
        assert (r["ids"], r["used"]) == (" ".join(map(str, ids)), used), text[:80]
