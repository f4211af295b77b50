"""Streams of requests and results: deduplication, replay behind acknowledgements, progress, heartbeats, pacing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(requests: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Requests (id, ts) once each; an id is remembered for ``window`` of event time, where a
    bounded list would remember a number of ids."""
    return requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", window).dropDuplicatesWithinWatermark(["id"])


def unacknowledged(frames: DataFrame, acks: DataFrame) -> DataFrame:
    """Frames (session, seq) beyond the largest acknowledged one: what a client gets again."""
    last = acks.groupBy("session").agg(F.max("ack").alias("ack"))
    return frames.dropDuplicates(["session", "seq"]).join(last, "session", "left").where(F.col("seq") > F.coalesce("ack", F.lit(-1))).drop("ack")


def progress(results: DataFrame) -> DataFrame:
    """(job, ok) to running counts of a job: completed and failed so far."""
    return results.groupBy("job").agg(F.count("*").alias("completed"), F.count_if(~F.col("ok")).alias("failed"))


def sessions_reset(frames: DataFrame) -> DataFrame:
    """Frames (session, page_id, seq) with ``generation``: a changed page_id starts a new one. Stateful by session."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        page, generation = state.get if state.exists else (None, -1)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for p in rows["page_id"]:
            if p != page:
                page, generation = p, generation + 1
            out.append(generation)
        state.update((page, generation))
        yield rows.assign(generation=out)[["session", "page_id", "seq", "generation"]]

    return frames.groupBy("session").applyInPandasWithState(run, "session string, page_id string, seq long, generation long", "page_id string, generation long", "append", GroupStateTimeout.NoTimeout)


def paced(calls: DataFrame, interval: float) -> DataFrame:
    """Live calls (host, call_id, arrival, duration) with their start, each behind the last of its host. Stateful by host."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values(["arrival", "call_id"])
        starts = []
        for arrival, duration in zip(rows["arrival"], rows["duration"], strict=True):
            starts.append(max(arrival, free))
            free = starts[-1] + max(interval, duration)
        state.update((free,))
        yield rows.assign(start=starts)[["host", "call_id", "start"]]

    return calls.groupBy("host").applyInPandasWithState(run, "host string, call_id long, start double", "free double", "append", GroupStateTimeout.NoTimeout)


def heartbeats(items: DataFrame, idle_ms: int = 15_000) -> DataFrame:
    """(job, item) passed on as (job, type, item), with a heartbeat where a job was idle."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield pd.DataFrame({"job": [key[0]], "type": ["heartbeat"], "item": [None]})
        for pdf in batches:
            yield pdf.assign(type="item")[["job", "type", "item"]]
        state.update((1,))
        state.setTimeoutDuration(idle_ms)

    return items.groupBy("job").applyInPandasWithState(run, "job string, type string, item string", "seen int", "append", GroupStateTimeout.ProcessingTimeTimeout)
