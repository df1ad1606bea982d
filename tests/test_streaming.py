"""Streams give what the batch operators give."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from guardframe.functions.sqlfuncs import register
from guardframe.operators import redact, responses, toolgate
from guardframe.plans import fixtures as X
from guardframe.plans.config import ToolGate
from guardframe.streaming import sinks
from guardframe.streaming.status import latest_status, status_stream


def test_jsonl_round_trip(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("req-1", "p1", None), ("req-2", "p1", "x")], "request_id string, project_id string, note string").write.json(str(source))
    events = spark.readStream.schema("request_id string, project_id string, note string").json(str(source))
    seen: list[int] = []
    counters = sinks.Counters()
    query = sinks.emit(events, {"file": sinks.jsonl_sink(str(tmp_path / "out")), "count": lambda df, n: (seen.append(df.count()), (2, 0))[1]}, str(tmp_path / "cp"), counters=counters)
    query.awaitTermination(60)
    found = sorted((json.loads(r["value"]) for r in sinks.jsonl(spark, str(tmp_path / "out")).collect()), key=lambda e: e["request_id"])
    assert found == [{"request_id": "req-1", "project_id": "p1"}, {"request_id": "req-2", "project_id": "p1", "note": "x"}]
    assert sum(seen) == 2 and (counters.enqueued, counters.delivered, counters.failed) == (2, {"file": 2, "count": 2}, {"file": 0, "count": 0})


def test_a_batch_given_again_is_written_once(spark, tmp_path):
    events, sink = spark.range(3), sinks.jsonl_sink(str(tmp_path / "out"))
    for _ in range(2):
        assert sink(events, 7) == (3, 0)
    assert sinks.jsonl(spark, str(tmp_path / "out")).count() == 3


def test_webhook_keeps_what_it_could_not_deliver(spark, tmp_path):
    events = spark.range(10).selectExpr("id").repartition(3)
    send = lambda url, body: 500 if json.loads(body)["id"] % 5 == 0 else 204
    sink = sinks.webhook_sink("http://x", str(tmp_path / "lost"), send, wait=lambda s: None)
    assert sink(events, 1) == (8, 2)
    assert sorted(json.loads(r["value"])["id"] for r in spark.read.text(str(tmp_path / "lost")).collect()) == [0, 5]
    with pytest.raises(OSError):
        sinks.webhook_sink("http://x", None, send, wait=lambda s: None)(events, 1)
    assert sinks.webhook_sink("http://x", None, lambda u, b: 200)(events, 2) == (10, 0)


def test_a_failing_sink_does_not_keep_the_batch_from_others(spark, tmp_path):
    counters, events = sinks.Counters(), spark.range(4)

    def broken(df, n):
        raise ValueError("no")

    write = sinks.fan_out({"broken": broken, "file": sinks.jsonl_sink(str(tmp_path / "out"))}, counters)
    with pytest.raises(RuntimeError):
        write(events, 0)
    assert counters.delivered == {"broken": 0, "file": 4} and counters.failed == {"broken": 4, "file": 0} and counters.errors == ["broken: no"]
    assert not events.is_cached and sinks.jsonl(spark, str(tmp_path / "out")).count() == 4


def test_state_is_written_whole(tmp_path):
    path = tmp_path / "deep" / "state.json"
    sinks.write_atomically(str(path), "one")
    sinks.write_atomically(str(path), "two")
    assert path.read_text() == "two" and [p.name for p in path.parent.iterdir()] == ["state.json"]


def test_webhook_attempts():
    replies, waits = iter([500, OSError(), 204]), []

    def send(url: str, body: bytes) -> int:
        reply = next(replies)
        if isinstance(reply, Exception):
            raise reply
        return reply

    assert sinks.deliver("http://x", b"{}", send, waits.append) and waits == [0.1, 0.3]
    assert not sinks.deliver("http://x", b"{}", lambda u, b: 500, lambda s: None)


def test_status_stream_equals_batch(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m, tzinfo=dt.UTC)
    schema = "request_id string, project_id string, status string, ts timestamp"
    updates = [("a", "p", "pending", at(0)), ("a", "p", "completed", at(5)), ("b", "p", "pending", at(1))]
    spark.createDataFrame(updates, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = status_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute"))
    query = stream.writeStream.format("memory").queryName("status_rows").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    live = {r["request_id"]: r["status"] for r in spark.table("status_rows").collect() if r["status"] != "expired"}
    batch = latest_status(spark.createDataFrame(updates, schema), F.lit(at(6)))
    assert live == {r["request_id"]: r["status"] for r in batch.collect()} == {"a": "completed", "b": "pending"}
    assert {r["request_id"] for r in latest_status(spark.createDataFrame(updates, schema), F.lit(at(33))).collect()} == {"a"}


def test_sql_functions(spark):
    df = spark.createDataFrame([("mail a@b.co",), ("rm -rf /",), ("r\\m  -rf '/'",), ("authorization: bearer abc.def see https://u@h.example/a/b?c=1",), (None,)], "t string")
    df.createOrReplaceTempView("texts")
    assert register(spark) == ["pii_labels", "redact_pii", "redact_output", "redact_log", "normalize_shell", "tool_gate_action", "guard_decision", "sse_text", "sse_events", "segments"]
    found = spark.sql("SELECT redact_pii(t) AS r, array_join(pii_labels(t), ',') AS l, guard_decision(t) AS g FROM texts").collect()
    assert [tuple(r) for r in found][:2] == [("mail [REDACTED_EMAIL]", "pii.email", "allow"), ("rm -rf /", "", "warn")]
    t = F.col("t")
    same = df.select(t, redact.log_line(t).alias("log"), toolgate.normalized_shell(t).alias("shell"), redact.output(t).alias("output"))
    same.createOrReplaceTempView("same")
    assert spark.sql("SELECT * FROM same WHERE NOT (redact_log(t) <=> log AND normalize_shell(t) <=> shell AND redact_output(t) <=> output)").collect() == []
    calls = df.where("t IS NOT NULL").select(t, F.lit("shell").alias("name"), F.lit("").alias("type"), F.to_json(F.struct(t.alias("command"))).alias("args"))
    toolgate.judge(calls, ToolGate()).createOrReplaceTempView("judged")
    rows = spark.sql("SELECT t, action, tool_gate_action(t) AS said FROM judged").collect()
    assert [r for r in rows if r["action"] != r["said"]] == [] and {r["said"] for r in rows} == {"block", "allow"}


def test_stream_and_segment_functions(spark):
    register(spark)
    streams = spark.createDataFrame(X.SSE_CASES, "id string, stream string").withColumn("text", responses.sse_text(F.col("stream")))
    streams.createOrReplaceTempView("streams")
    assert spark.sql("SELECT id, text, sse_text(stream) FROM streams WHERE NOT (sse_text(stream) <=> text)").collect() == []
    events = spark.sql("SELECT id, e.pos, e.data FROM streams, LATERAL sse_events(stream) e").collect()
    assert len(events) > 4 and all(e["data"].strip() and e["data"] != "[DONE]" for e in events)
    bodies = spark.createDataFrame(X.INPUT_BODIES, "id string, body string")
    bodies.createOrReplaceTempView("bodies")
    plain = bodies.select("id", F.posexplode(responses.input_segments(F.col("body")))).select("id", "pos", "col.role", "col.text")
    assert sorted(map(tuple, spark.sql("SELECT id, s.pos, s.role, s.text FROM bodies, LATERAL segments(body) s").collect())) == sorted(map(tuple, plain.collect()))
