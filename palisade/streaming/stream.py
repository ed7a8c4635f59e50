"""The pipeline on Structured Streaming: stateless parts as they are, state with watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.correlate import fingerprint, suppress
from ..operators.detect import threats
from ..operators.respond import plan_actions
from ..options import PipelineOptions
from ..plans.analyze import detections
from . import stateful


def stream_threats(lines: DataFrame, options: PipelineOptions = PipelineOptions()) -> DataFrame:
    """Threat events of a stream of lines, with fingerprint."""
    return threats(detections(lines, options)).where("ts is not null").withColumn("fingerprint", fingerprint())


def stream_signals(events: DataFrame, options: PipelineOptions = PipelineOptions(), suppressions: DataFrame | None = None, late_seconds: int = 60) -> DataFrame:
    """Threat events (see stream_threats) suppressed, deduplicated and correlated, as ``analyze`` does for batches.

    An event comes out when the watermark, ``late_seconds`` behind the newest event, has passed it.
    """
    timed = events.withColumn("ts_us", F.unix_micros("ts")) if "ts_us" not in events.columns else events
    kept = timed if suppressions is None else suppress(timed, suppressions, "ts_us")
    unique = stateful.leading_edge(kept.withWatermark("ts", f"{late_seconds} seconds"), "fingerprint", options.dedup_ttl)
    return stateful.correlate(unique, options.window_seconds, options.max_events_per_window)


def stream_actions(correlated: DataFrame, options: PipelineOptions = PipelineOptions()) -> DataFrame:
    """Actions of a stream of correlated events (``ts`` with its watermark): planned, idempotent, and admitted or not by the tenant's rate limit."""
    planned = plan_actions(correlated, "ts_us", keep=("ts",))
    place = F.concat_ws("|", F.col("event_id").cast("string"), F.lpad(F.col("position").cast("string"), 3, "0"))
    tied = planned.withColumn("_tie", place).withColumn("_tenant", F.coalesce(F.col("target.tenant"), F.lit("")))
    once = stateful.leading_edge(tied, "idempotent_key", options.idempotency_ttl, tie="_tie", inclusive=True)
    return stateful.rate_limited(once, "_tenant", "action_id", options.max_actions_per_second).drop("_tie", "_tenant")


def unique_within_watermark(events: DataFrame, ttl_seconds: int, ts: str = "ts") -> DataFrame:
    """The first event of each fingerprint; state goes when the watermark has passed it by the TTL."""
    return events.withWatermark(ts, f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark(["fingerprint"])


def leading_edge_stream(events: DataFrame, ttl_seconds: int, key: str = "fingerprint", ts: str = "ts", late_seconds: int = 60) -> DataFrame:
    """(key, ts) of the kept events: no kept event of the key is younger than the TTL.

    State is the time of the last kept event; it is dropped once the watermark is past its TTL.
    """

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(t for part in parts for t in part["us"].tolist()):  # a key's rows of one trigger
            if last is None or t - last >= ttl_seconds * 1_000_000:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [keys[0]] * len(kept), "us": kept})

    timed = events.withWatermark(ts, f"{late_seconds} seconds").select(key, ts, F.unix_micros(F.col(ts)).alias("us"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} string, us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, seconds: int = 60, ts: str = "ts", late_seconds: int = 60) -> DataFrame:
    """Threat counts by tumbling window and tenant."""
    return events.withWatermark(ts, f"{late_seconds} seconds").groupBy(F.window(ts, f"{seconds} seconds"), "tenant").agg(F.count("*").alias("threats"), F.max("confidence").alias("confidence"))


def start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Run a stream with foreachBatch; a batch id comes again after a failure, so ``write`` should be idempotent."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
