"""Sinks for activation events, in batch and in streams.

A sink is called with a batch's events and its number and returns how many
events it took and how many it couldn't deliver. Spark may give a batch again
after a failure, so sinks write by the batch's number.
"""

from __future__ import annotations

import os
import tempfile
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from guardframe.operators.activation import event_line

Sink = Callable[[DataFrame, int], tuple[int, int]]
RETRY_SECONDS = (0.1, 0.3)


def as_json(events: DataFrame) -> DataFrame:
    """Events as JSON lines (column ``value``); null fields are left out."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def jsonl_sink(path: str) -> Sink:
    """Writes each batch as JSON lines into a folder of its own, so a batch that is given again
    replaces what it left; Spark's committer makes it appear whole. Read with ``jsonl``."""

    def write(events: DataFrame, batch: int) -> tuple[int, int]:
        lines = as_json(events)
        lines.write.mode("overwrite").text(f"{path}/batch={batch}")
        return lines.count(), 0

    return write


def jsonl(spark, path: str) -> DataFrame:
    """All lines that a JSON-lines sink has written, with the number of their batch."""
    return spark.read.text(path)


def post(url: str, body: bytes, headers: Mapping[str, str] | None = None, timeout: float = 2.0) -> int:
    request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json", **(headers or {})}, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return reply.status


def deliver(url: str, body: bytes, send: Callable[[str, bytes], int] = post, wait: Callable[[float], None] = time.sleep) -> bool:
    """Three attempts; any 2xx is a success."""
    for pause in (*RETRY_SECONDS, None):
        try:
            if 200 <= send(url, body) < 300:
                return True
        except OSError:
            pass
        if pause is not None:
            wait(pause)
    return False


def webhook_sink(url: str, failures: str | None = None, send: Callable[[str, bytes], int] | None = None, headers: Mapping[str, str] | None = None, wait: Callable[[float], None] = time.sleep) -> Sink:
    """Posts each event from the executors. Events that three attempts didn't deliver are written
    below ``failures``, by batch; without such a folder the batch fails, and is given again."""
    transport = send or (lambda to, body: post(to, body, headers))

    def partition(rows: Iterable) -> Iterator[tuple[bool, str | None]]:
        for row in rows:
            done = deliver(url, row["value"].encode(), transport, wait)
            yield done, None if done else row["value"]

    def attempt(batches):
        import pyarrow as pa

        for batch in batches:
            found = list(partition({"value": v} for v in batch.column("value").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.string())], names=["done", "value"])

    def write(events: DataFrame, batch: int) -> tuple[int, int]:
        # Kept before anything reads it, as reading it twice would post twice.
        tried = as_json(events).mapInArrow(attempt, "done boolean, value string").persist()
        try:
            counts = {r["done"]: r["count"] for r in tried.groupBy("done").count().collect()}
            lost = counts.get(False, 0)
            if lost and failures is None:
                raise OSError(f"{lost} events of batch {batch} weren't delivered")
            if lost:
                tried.where("NOT done").select("value").write.mode("overwrite").text(f"{failures}/batch={batch}")
            return counts.get(True, 0), lost
        finally:
            tried.unpersist()

    return write


def log_sink(say: Callable[[str], None] = print, vendor: str = "acme") -> Sink:
    """Says each event as one redacted JSON line, on the executors."""

    def write(events: DataFrame, batch: int) -> tuple[int, int]:
        lines = events.select(F.concat(F.lit("activation: "), event_line(events, vendor)).alias("value"))
        lines.foreach(lambda row: say(row["value"]))
        return lines.count(), 0

    return write


def response_header(events: DataFrame, vendor: str = "acme") -> Column:
    """The redacted event as the text of a response header: one line of what a header may hold."""
    return F.regexp_replace(event_line(events, vendor), r"[\r\n]+", " ")


@dataclass
class Counters:
    """What the emitter has done: events given to it, and by sink delivered and failed ones."""

    enqueued: int = 0
    delivered: dict[str, int] = field(default_factory=dict)
    failed: dict[str, int] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)

    def add(self, sink: str, delivered: int, failed: int) -> None:
        self.delivered[sink] = self.delivered.get(sink, 0) + delivered
        self.failed[sink] = self.failed.get(sink, 0) + failed


def fan_out(sinks: Mapping[str, Sink], counters: Counters) -> Callable[[DataFrame, int], None]:
    """Gives a batch to all sinks. One that fails doesn't keep it from the others; if any failed,
    the batch fails after all had it, so that it is given again."""

    def write(events: DataFrame, batch: int) -> None:
        events.persist()
        faults = []
        try:
            number = events.count()
            counters.enqueued += number
            for name, sink in sinks.items():
                try:
                    counters.add(name, *sink(events, batch))
                except Exception as error:  # noqa: BLE001  any fault of a sink is its own
                    counters.add(name, 0, number)
                    faults.append(f"{name}: {error}")
        finally:
            events.unpersist()
        counters.errors += faults
        if faults:
            raise RuntimeError("; ".join(faults)[:2000])

    return write


def emit(events: DataFrame, sinks: Mapping[str, Sink], checkpoint: str, trigger: dict | None = None, counters: Counters | None = None) -> StreamingQuery:
    """A stream to all sinks. Spark holds the source back instead of dropping events; limit what
    a batch takes with the source's options."""
    write = fan_out(sinks, counters if counters is not None else Counters())
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def write_atomically(path: str, text: str) -> None:
    """A small state file: readers see the old text or the new one, never a part."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
