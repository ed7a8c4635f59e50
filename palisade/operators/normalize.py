"""Raw events to normalised events: one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masking import masked
from ..functions.net import http_method, http_path, http_status, location, normal_ip, query_pairs, severity_level, user_agent


def normalize_events(events: DataFrame) -> DataFrame:
    """Core, HTTP, database, cloud and container fields; the message is masked (masked_fields names the kinds).

    The message is the decoded query, else the query (an empty one counts, if the format has queries), else the message.
    """
    decoded = F.col("decoded_query") if "decoded_query" in events.columns else F.lit(None).cast("string")
    message = F.coalesce(F.nullif(decoded, F.lit("")), F.when(F.col("format") != "json", F.col("query")), F.nullif("query", F.lit("")), F.col("message"), F.lit(""))
    kept = [c for c in ("event_ts", "line_number", "source", "fields") if c in events.columns]
    has_http = F.col("method").isNotNull()
    out = events.select(
        "event_id", *kept, F.col("timestamp").alias("ts"), F.coalesce("tenant", F.lit("default")).alias("tenant"), normal_ip(F.col("source_ip")).alias("source_ip"),
        severity_level(F.col("level")).alias("severity"), F.col("format").alias("original_format"), message.alias("message"),
        F.when(has_http, http_method(F.col("method"))).alias("http_method"), F.when(F.col("path").isNotNull(), http_path(F.col("path"))).alias("http_path"),
        http_status(F.col("status_code")).alias("http_status"), F.nullif("user_agent", F.lit("")).alias("http_user_agent"), F.col("referer").alias("http_referer"),
        F.when(F.coalesce("user_agent", F.lit("")) != "", user_agent(F.col("user_agent"))).alias("user_agent_info"), query_pairs(F.when(F.col("format") != "database_audit", F.col("query"))).alias("query_params"),
        F.col("operation").alias("db_operation"), F.col("database").alias("db_name"), F.col("user").alias("db_user"), F.nullif("user", F.lit("-")).alias("remote_user"),
        F.col("action").alias("cloud_action"), F.col("resource").alias("cloud_resource"), F.col("role").alias("cloud_role"), F.col("result").alias("cloud_result"),
        F.col("pod").alias("container_pod"), F.col("container").alias("container_name"), "bytes_sent", "session_id",
    )
    return masked(out.withColumn("geolocation", location(F.col("source_ip"))), "message")
