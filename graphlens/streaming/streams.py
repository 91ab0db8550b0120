"""Structured Streaming versions of joins, limits and publishing; operators with timers and expiry are in ``timers``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def correlate(starts: DataFrame, ends: DataFrame, delay: str = "10 minutes", longest: str = "1 hour") -> DataFrame:
    """Starts (call_id, ts) and ends (call_id, ts) of calls joined as they come; repeats within the watermark are dropped,
    and state older than the longest call is let go."""
    a = starts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["call_id"]).select(F.col("call_id").alias("a_id"), F.col("ts").alias("started"))
    b = ends.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["call_id"]).select(F.col("call_id").alias("b_id"), F.col("ts").alias("ended"))
    near = (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {longest}"))
    return a.join(b, (F.col("a_id") == F.col("b_id")) & near).select(F.col("a_id").alias("call_id"), "started", "ended")


def allowed_in_window(times: list[float], limit: int, window: float) -> list[bool]:
    """Fixed windows that open at the first request after the last one closed (the batch twin's inner loop)."""
    out, start, used = [], None, 0
    for t in times:
        if start is None or t - start >= window:
            start, used = t, 0
        used += 1
        out.append(used <= limit)
    return out


def rate_limited(requests: DataFrame, limit: int, window_seconds: float) -> DataFrame:
    """Requests (client, ts) with ``allowed``, in batch: one ordered pass per client, as the windows depend on the data."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        return pdf.assign(allowed=allowed_in_window((pdf["ts"].astype("int64") / 1e9).tolist(), limit, window_seconds))[["client", "ts", "allowed"]]

    return requests.select("client", F.col("ts").cast("timestamp_ntz").alias("ts")).groupBy("client").applyInPandas(one, "client string, ts timestamp_ntz, allowed boolean")


def rate_limited_stream(requests: DataFrame, limit: int, window_seconds: float) -> DataFrame:
    """The same on a stream: state per client is its window's start and the requests in it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(frames)).sort_values("ts")
        out = []
        for t in (pdf["ts"].astype("int64") / 1e9).tolist():
            if start is None or t - start >= window_seconds:
                start, used = t, 0
            used += 1
            out.append(used <= limit)
        state.update((start, used))
        yield pdf.assign(allowed=out)[["client", "ts", "allowed"]]

    return requests.select("client", F.col("ts").cast("timestamp_ntz").alias("ts")).groupBy("client").applyInPandasWithState(step, "client string, ts timestamp_ntz, allowed boolean", "start double, used int", "append", GroupStateTimeout.NoTimeout)


def publish_batches(changes: DataFrame, store, checkpoint: str):
    """Each micro-batch of changed rows becomes an overlay of the store; an empty batch none, and one that comes again
    after a failure none either: the manifest holds the number of the last one. Returns the query."""

    def publish(batch: DataFrame, number: int) -> None:
        store.publish(batch, batch=(checkpoint, number))
        if store.due():
            store.compact()

    return changes.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
