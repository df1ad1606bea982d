"""Request status with a time to live: pending, then completed, then gone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_SECONDS = 30 * 60


def latest_status(updates: DataFrame, now, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """The batch form: each (request, project)'s latest status, without those that are older than the time to live.

    Input: request_id, project_id, status, ts.
    """
    last = updates.groupBy("request_id", "project_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("ts"))
    return last.where(F.unix_timestamp("ts") + ttl_seconds > F.unix_timestamp(now))


def status_stream(updates: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """The stream form: a row for every change and one (``expired``) when the time to live has passed.

    Input: request_id, project_id, status, ts (the event time with a watermark).
    State is one status per request, so it is bounded by what is alive.
    """
    out = "request_id string, project_id string, status string, ts timestamp"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        request, project = key
        if state.hasTimedOut:
            _, ts = state.get
            state.remove()
            yield pd.DataFrame({"request_id": [request], "project_id": [project], "status": ["expired"], "ts": [pd.Timestamp(ts, unit="us")]})
            return
        best = state.get if state.exists else ("", -1)
        for batch in batches:
            for status, ts in zip(batch["status"], batch["ts"], strict=True):
                best = max(best, (status, int(pd.Timestamp(ts).value // 1000)), key=lambda x: (x[1], x[0]))
        state.update(best)
        state.setTimeoutTimestamp(max(best[1] // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"request_id": [request], "project_id": [project], "status": [best[0]], "ts": [pd.Timestamp(best[1], unit="us")]})

    return updates.groupBy("request_id", "project_id").applyInPandasWithState(step, out, "status string, ts long", "update", GroupStateTimeout.EventTimeTimeout)
