"""Streams of telemetry and chunk requests.  These extend the batch operators; they are not needed for them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxelarium.sources.formats import DOWNLOADS


def read(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """Arriving telemetry files, with event time ts."""
    s = spark.readStream.schema(DOWNLOADS).option("maxFilesPerTrigger", max_files).json(path)
    return s.withColumn("ts", F.timestamp_millis("t"))


def per_window(stream: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Downloads and bytes per host and window; late events are dropped behind the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "host").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).select(F.col("window.start").alias("start"), "host", "n", "bytes")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "host").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "host", "n")


def request_states(requests: DataFrame, cooldown_ms: int = 10_000, idle_ms: int | None = None) -> DataFrame:
    """Chunk requests (chunk, kind, at) through a state machine: the first request of a chunk dispatches it, others are
    absorbed until a `done` or `failed` arrives, and a failure holds the chunk back for a cooldown.

    With idle_ms the state of a chunk that nothing is heard of for so long is dropped (processing time); a request after
    that dispatches it again.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        phase, until = state.get if state.exists else ("missing", 0)
        out = []
        rows = pd.concat(list(frames)).sort_values("at")
        for kind, at in zip(rows["kind"], rows["at"], strict=True):
            if kind == "request" and (phase == "missing" or (phase == "cooldown" and at >= until)):
                phase = "pending"
                out.append(("dispatch", int(at)))
            elif kind == "done" and phase == "pending":
                phase = "resident"
                out.append(("resident", int(at)))
            elif kind == "failed" and phase == "pending":
                phase, until = "cooldown", int(at) + cooldown_ms
                out.append(("cooldown", int(at)))
        state.update((phase, until))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], a, b) for a, b in out], columns=["chunk", "action", "at"])

    return requests.groupBy("chunk").applyInPandasWithState(step, "chunk string, action string, at long", "phase string, until long", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
