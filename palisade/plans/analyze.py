"""The whole pipeline: lines to signals and actions."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import staged
from ..operators import correlate as co
from ..operators import respond as re_
from ..operators.detect import detect, rule_set, threats
from ..operators.evaluate import run_metrics
from ..operators.ml import TextModel, session_anomalies
from ..operators.normalize import normalize_events
from ..operators.parse import for_tenant, parse_lines, with_decoded_query
from ..operators.sessions import session_features, session_key
from ..operators.windows import micros, settled
from ..options import PipelineOptions
from ..sources.sinks import metric_rows


@dataclass(frozen=True)
class Analysis:
    events: DataFrame
    detected: DataFrame
    correlated: DataFrame
    actions: DataFrame
    suppressed: DataFrame | None
    duplicates: DataFrame

    def statistics(self) -> DataFrame:
        """correlation_statistics of the run, its suppressed and duplicate events counted."""
        return co.correlation_statistics(self.correlated, self.suppressed, self.duplicates)

    def record(self, started: datetime, ended: datetime) -> DataFrame:
        """The metrics row of the run (see metric_rows)."""
        metrics = run_metrics(self.events, self.detected, self.actions, max((ended - started).total_seconds(), 1e-9))
        return metric_rows(metrics, self.statistics(), re_.action_statistics(self.actions), started, ended)


#: What a session's history is judged by.
SESSION_COLUMNS = ["event_count", "unique_ips", "unique_paths", "error_count", "requests_per_second", "avg_length"]


def with_anomalies(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Adds anomaly_score (0 to 1): the event's session of the last ``seconds`` against what its key did before (see session_anomalies).

    It is the forest's score, of which detection's thresholds (0.7, 0.8) are; a distance from 1/2 never reaches them.
    """
    # read several times below; whole rows move once, when they get their score
    keyed = staged(events.withColumns({"_row": F.monotonically_increasing_id(), "_session": session_key(), "_ts": micros("ts")}), "events")
    error = F.coalesce(F.substring(F.col("http_status").cast("string"), 1, 1).isin("4", "5"), F.lit(False))
    slim = keyed.select("_row", "event_id", "_session", "_ts", "source_ip", "http_path", error.alias("_error"), F.length("message").alias("_length"))
    found = session_features(slim, "_session", "_ts", {"unique_ips": "source_ip", "unique_paths": "http_path"}, F.col("_error"), F.col("_length"), seconds)
    judged = staged(found.select("_row", "event_id", "_session", "_ts", *SESSION_COLUMNS), "sessions")
    scores = session_anomalies(judged, "_session", "_ts", "event_id", SESSION_COLUMNS, neutral=0.0).select("_row", "anomaly_score")
    return keyed.join(scores, "_row").select(*events.columns, "anomaly_score")


def detections(lines: DataFrame, options: PipelineOptions = PipelineOptions(), tenant: str | None = None, model: TextModel | None = None) -> DataFrame:
    """Parse, normalise, detect.  Stateless, so the same for batches and streams, but for ``options.sessions``, which batches only heed."""
    events = normalize_events(with_decoded_query(for_tenant(parse_lines(lines), tenant)))
    if model is not None and options.enable_ml:
        events = model.score(events, "message")
    if options.sessions and not lines.isStreaming:
        events = with_anomalies(settled(events), options.window_seconds)
    return detect(events, rule_set(options.rule_set), options.anomaly_threshold).withColumn("ts_us", micros("ts"))


def analyze(lines: DataFrame, options: PipelineOptions = PipelineOptions(), tenant: str | None = None, model: TextModel | None = None, suppressions: DataFrame | None = None) -> Analysis:
    """Threats with a time are suppressed, deduplicated, correlated and answered; those without pass uncorrelated.

    Threats and correlated events are staged, as several results come from each.
    """
    detected = detections(settled(lines), options, tenant, model)
    found = staged(threats(detected).withColumn("_row", F.monotonically_increasing_id()), "threats")
    timed, untimed = found.where("ts_us is not null"), found.where("ts_us is null")
    out = None
    if suppressions is not None:
        out = co.suppressed(timed, suppressions, "ts_us").drop("_row")
        timed = co.suppress(timed, suppressions, "ts_us")
    marked = timed.withColumn("fingerprint", co.fingerprint())
    slim = staged(marked.select("_row", "fingerprint", "ts_us", "event_id"), "fingerprints")  # only this goes through sorted ranges
    kept = co.leading_edge(slim, "fingerprint", "ts_us", "event_id", options.dedup_ttl).select("_row", "kept")
    edge = staged(marked.join(kept, "_row").drop("_row"), "edge")
    unique = edge.where("kept").drop("kept")
    correlated = co.correlate(unique, "ts_us", options.window_seconds, options.max_events_per_window)
    correlated = staged(correlated.unionByName(co.uncorrelated(untimed.drop("_row").withColumn("fingerprint", co.fingerprint()))), "correlated")
    planned = staged(re_.idempotent_actions(re_.plan_actions(correlated, "ts_us"), options.idempotency_ttl), "planned")  # limits read them twice
    tied = planned.withColumn("_tenant", F.coalesce(F.col("target.tenant"), F.lit("")))
    limited = re_.rate_limited(tied, ["_tenant"], "ts_us", "action_id", options.max_actions_per_second).where("admitted").drop("_tenant", "admitted")
    return Analysis(detected, detected, correlated, re_.execute(limited), out, edge.where("not kept").drop("kept"))
