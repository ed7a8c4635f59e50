"""JSON lines of signals, actions and metrics, written and read."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import excerpt

SIGNALS = (
    "event_id string, ts string, tenant string, src_ip string, severity string, threat_types array<string>, reason string, matched_rules array<string>, "
    "ml_score double, window string, correlation_id string, masked_fields array<string>, sanitized_excerpt string, action_planned array<string>"
)
ACTIONS = "action_id string, ts string, correlation_id string, kind string, target struct<ip:string,ttl_sec:int>, status string, reason string, idempotent_key string"

METRICS = (
    "throughput_lps double, duration_seconds double, total_lines long, parsed_lines long, threat_events long, actions_taken long, error_count long, rule_hits long, "
    "correlation_stats map<string,double>, action_stats map<string,double>, start_time string, end_time string"
)


def metric_rows(metrics: DataFrame, correlations: DataFrame, actions: DataFrame, started: datetime, ended: datetime) -> DataFrame:
    """The record of a run from its one-row tables: run_metrics, correlation_statistics and action_statistics."""

    def as_map(df: DataFrame, name: str) -> DataFrame:
        pairs = [x for c, kind in df.dtypes if kind in ("bigint", "int", "double") for x in (F.lit(c), F.col(c).cast("double"))]
        return df.select(F.create_map(*pairs).alias(name), F.lit(1).alias("_"))

    seconds = (ended - started).total_seconds()
    times = {"start_time": F.lit(started.isoformat()), "end_time": F.lit(ended.isoformat()), "duration_seconds": F.lit(seconds), "_": F.lit(1)}
    rate = F.round(F.coalesce(F.try_divide(F.col("total_lines"), F.lit(seconds)), F.lit(0.0)), 2)
    extra = {c: F.col(c) if c in metrics.columns else F.lit(0).cast("long") for c in ("parsed_lines", "error_count")}
    row = metrics.withColumns(times | extra | {"throughput_lps": rate})
    joined = row.join(as_map(correlations, "correlation_stats"), "_").join(as_map(actions, "action_stats"), "_")
    return joined.select(*(f.split()[0] for f in METRICS.split(", ")))


def signal_rows(correlated: DataFrame, window_seconds: int = 60) -> DataFrame:
    """The signal record of correlated events (with kinds of the actions planned, if there)."""
    planned = F.col("action_planned") if "action_planned" in correlated.columns else F.array().cast("array<string>")
    score = F.col("ml_score") if "ml_score" in correlated.columns else F.lit(None).cast("double")
    return correlated.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), F.coalesce("tenant", F.lit("default")).alias("tenant"), F.col("source_ip").alias("src_ip"),
        F.col("final_severity").alias("severity"), "threat_types", "reason", "matched_rules", score.alias("ml_score"), F.lit(f"{window_seconds}s").alias("window"),
        "correlation_id", "masked_fields", excerpt(F.col("message")).alias("sanitized_excerpt"), planned.alias("action_planned"),
    )


def action_rows(actions: DataFrame) -> DataFrame:
    time = F.date_format(F.coalesce("executed_at", "created_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    target = F.struct(F.col("target.ip").alias("ip"), F.col("target.ttl_sec").alias("ttl_sec"))
    return actions.select("action_id", time.alias("ts"), "correlation_id", "kind", target.alias("target"), "status", "reason", "idempotent_key")


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the schema; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def batch_writer(folder: str, tables: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: JSON lines of each table (name: rows of a batch) below ``folder``, every batch once.

    A batch has a folder of its own, named by its query and its number: both are
    the same when Spark replays it after a failure.  A folder with Spark's success
    mark is left alone; one that a failed attempt has left is overwritten.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        kept = batch.persist()
        for name, rows in tables.items():
            path = f"{folder}/{name}/query={query}/batch={number}"
            if not path_exists(spark, f"{path}/_SUCCESS"):
                rows(kept).write.mode("overwrite").json(path)
        kept.unpersist()

    return write


def read_batches(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """All rows that batch_writer has put into a table; what an unfinished batch has left is Spark's to hide."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("basePath", f"{folder}/{name}").json(f"{folder}/{name}")


BATCH_METRICS = "signals long, correlated long, first_us long, last_us long"


def batch_metrics(correlated: DataFrame) -> DataFrame:
    """One row of a batch: how many signals, how many correlated, and from when to when."""
    us = F.unix_micros("ts")
    return correlated.agg(F.count("*").alias("signals"), F.count_if("correlated").alias("correlated"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))
